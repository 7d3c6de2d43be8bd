"""Plain Python models of JSON strictness, numbers, simple pairs and lockout."""

import json

def simple(line):
    out = {}
    if "=" in line:
        for word in line.split():
            if "=" in word:
                key, _, value = word.partition("=")
                out[key] = value
    return out


def is_json(line):
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def kind_and_text(value):
    """Type label and display of a key=value value."""
    try:
        return "int", f"{int(value):,}"
    except ValueError:
        pass
    try:
        return "float", f"{float(value):.2f}"
    except ValueError:
        return None, None


def lockout(attempts):
    """Outcomes of one user's ``(seconds, ok)`` attempts."""
    count, until, out = 0, float("-inf"), []
    for at, ok in attempts:
        if until - at >= 1:
            out.append(("rejected", count))
        elif ok:
            count = 0
            out.append(("success", 0))
        else:
            count += 1
            if count >= 3:
                until = at + (600 if count >= 5 else 300)
            out.append(("warning" if count in (2, 4) else "failure", count))
    return out
