"""Operators that keep to one text: repetition, byte-pair trees, personal data, languages, toxicity."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linefold.llm import language_id, repetition, semi_crf, string_kernel, tree_bpe
from linefold.llm.common import bucket_of, hash_words, word_bytes
from linefold.llm.encoder import encoder

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
BPE = P.path("byte_bpe_50k.json")
ODD_TEXTS = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\n b", "\ta", "it's don't", "x<|endoftext|>y", "a\x1cb c", "中文 é 😀12"]


def repeats(text, least):
    """Covered words and longest repeat, pair by pair."""
    w = text.encode().split()
    cover, longest = set(), 0
    at = collections.defaultdict(list)
    for i in range(len(w)):
        at[w[i]].append(i)
    for places in at.values():
        for a in places:
            for b in places:
                if a < b:
                    n = 0
                    while b + n < len(w) and w[a + n] == w[b + n]:
                        n += 1
                    longest = max(longest, n)
                    if n >= least:
                        cover |= set(range(a, a + n)) | set(range(b, b + n))
    return len(cover), longest


def test_repetition_against_brute_force(corpus):
    draw = random.Random(1)
    texts = [t for _, t, _ in corpus[:60] if len(t) < 6000]
    texts += [" ".join(draw.choice("ab") for _ in range(60)) for _ in range(20)] + ["a " * 80, "", "x", "a b c " * 30 + "d"]
    made = dict(zip(repetition.COLUMNS, repetition.measure(texts)))
    for i, t in enumerate(texts):
        w = t.split()
        triples = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        assert made["n_words"][i] == len(w) and made["n_repeat_words"][i] == len(inside)
        assert (made["covered_words"][i], made["longest_repeat"][i]) == repeats(t, 8)
        assert made["word_chars"][i] == sum(map(len, w))
        assert made["n_symbols"][i] == len(re.findall(r"[#*$%&|<>]", t))


def test_maximal_repeats():
    assert repetition.maximal_repeats("a b c d x a b c d y b c".split(), 2) == [(4, [0, 5]), (2, [1, 6, 10])]
    assert repetition.maximal_repeats([], 1) == []


def test_repetition_rows(odd_rows, no_rows):
    rows = repetition.judge(odd_rows).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[4].n_words == 30_000 and by[5].base_failed and by[5].source == "s"
    assert repetition.judge(no_rows).count() == 0


def test_tree_bpe_equals_library(corpus):
    bpe = tree_bpe.coder(MULTI, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    draw = random.Random(2)
    signs = "abcdeéß€😀 \t\n\x1c\x85　中文12३.,'s!"
    texts = [t for _, t, _ in corpus] + ODD_TEXTS + ["a" * 3000, "ab" * 2000, " " * 300 + "x", "中" * 500]
    texts += ["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(800)]
    for t in texts:
        ids = bpe.encode(t).tolist()
        assert ids == library.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_join_of_any_cut():
    """Joining is right wherever the bytes are cut."""
    bpe = tree_bpe.coder(MULTI, P.PATTERN)
    for word in (b" international", b"aaaaaaaaaaaaaaaaaaaa", " Überraschung".encode(), b"0123456789" * 3):
        whole = bpe.merge(word)
        for cut in range(1, len(word)):
            assert bpe.join(bpe.merge(word[:cut]), bpe.merge(word[cut:])) == whole


def test_tree_bpe_rows(odd_rows, no_rows):
    rows = tree_bpe.round_trip(odd_rows, MULTI, P.PATTERN).collect()
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert {r.n_tokens for r in rows if not r.text} == {0}
    back = tree_bpe.decoded(tree_bpe.encoded(odd_rows, MULTI, P.PATTERN), MULTI, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert tree_bpe.round_trip(no_rows, MULTI, P.PATTERN).count() == 0


def test_encoder_equals_library(corpus):
    library, own = Tokenizer.from_file(BPE), encoder(BPE)
    texts = [t for _, t, _ in corpus] + ODD_TEXTS
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_word_hashes(corpus):
    rows = [word_bytes(t, lower=True) for _, t, _ in corpus] + [b""]
    hashes, counts = hash_words(rows)
    words = [w for r in rows for w in r.split()]
    assert counts.tolist() == [len(r.split()) for r in rows]
    seen = dict(zip(words, hashes.tolist()))
    assert [seen[w] for w in words] == hashes.tolist() and len(set(seen.values())) == len(seen)


def patterns(text):
    """The base spans by plain regular expressions."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and semi_crf.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


@pytest.fixture(scope="module")
def crf(corpus):
    return semi_crf.fit([t for _, t, _ in corpus])


def test_base_spans(corpus):
    draw = random.Random(3)
    texts = [t for _, t, _ in corpus] + ["".join(draw.choice("0123456789.@+- ()ab4") for _ in range(60)) for _ in range(4000)]
    for t in texts:
        assert semi_crf.base_spans(t) == patterns(t)


def test_field_decoding_is_optimal(crf):
    """Against every segmentation of short regions."""
    def score(region, cuts):
        cue, total = region.cue(), 0.0
        for i, j, kind in cuts:
            total += sum(crf.weights.get(f, 0.0) for f in semi_crf.segment_features(region, i, j, kind, cue))
        return total

    def every(by_end, n):
        if n == 0:
            yield []
        for i, kind, _, _ in by_end[n] if n else []:
            for rest in every(by_end, i):
                yield [*rest, (i, n, kind)]

    for text in ("555-123", "(98)55-24", "1.2.3.4"):
        bounds = [m.span() for m in re.finditer(r"[0-9]+|\D", text)]
        region = semi_crf.Region(text, bounds)
        best = max(every(crf.segments(region), len(bounds)), key=lambda c: score(region, c))
        spans = [(k, bounds[i][0], bounds[j - 1][1]) for i, j, k in best if k != semi_crf.NONE]
        assert crf.decode(region) == spans


@pytest.mark.parametrize("text", ["10.0.0.1 (415) 555-0199", "4111111111111111 (415) 555-0199", "+1 (988) 555-2485 / 415-555-0199", "(415) 555-0199 10.0.0.1"])
def test_numbers_next_to_a_pattern_span(crf, text):
    base, added = semi_crf.find(text, crf)
    assert len(base) == 1
    assert [(k, "".join(c for c in text[a:b] if c.isdigit())) for k, a, b in added] == [("phone", "4155550199")]


@pytest.mark.parametrize("text, want", [("write jane.doe at example.com", "jane.doe at example.com"), ("they arrive at school. See you", None)])
def test_spelt_address_alone(crf, text, want):
    """Nothing else in the text hints at an address."""
    assert [(k, text[a:b]) for k, a, b in semi_crf.find(text, crf)[1]] == ([("email", want)] if want else [])


def test_every_spelt_match_is_a_region():
    for text in ("jane.doe@example .com", "jane at example.com", "jane (at) example.com", "jane＠example.com"):
        assert [r.text[r.bounds[0][0] : r.bounds[-1][1]] for r in semi_crf.regions(text, [])] == [text]


def test_regions_leave_out_taken_spans():
    text = "1234567 99.99 7654321 88 22 1112223"
    taken = [("x", 8, 13), ("x", 22, 24), ("x", 22, 27)]
    pieces = [text[r.bounds[0][0] : r.bounds[-1][1]].strip() for r in semi_crf.regions(text, taken)]
    assert pieces == ["1234567", "7654321", "1112223"]


def test_field_gradient(crf):
    """Against finite differences of the log likelihood."""
    text = "x (988) 555-2485 y"
    region = semi_crf.regions(text, [])[0]
    gold = [("phone", 2, 16)]
    gradient = crf.gradient(region, gold)

    def likelihood(field):
        by_end, cue = field.segments(region), region.cue()
        n = len(region.tokens)
        forward = [0.0] + [0.0] * n
        for j in range(1, n + 1):
            forward[j] = semi_crf._log_sum([forward[i] + s for i, _, _, s in by_end[j]])
        feats = semi_crf.segment_features(region, 0, n, "phone", cue)
        return sum(field.weights.get(f, 0.0) for f in feats) - forward[n]

    for name in list(gradient)[:12]:
        up, down = dict(crf.weights), dict(crf.weights)
        up[name], down[name] = up.get(name, 0.0) + 1e-4, down.get(name, 0.0) - 1e-4
        slope = (likelihood(semi_crf.Field(up)) - likelihood(semi_crf.Field(down))) / 2e-4
        assert abs(slope - gradient[name]) < 1e-3


def test_field_adds_other_forms(crf):
    found = {
        "call me 555-123-4567 now": ["phone:8:20"],
        "write jane.doe at example dot com or so": ["email:6:33"],
        "look at the dot product at 5": [],
        "on 2024-01-02 at 12:33": [],
        "version 2.0.1.5000": [],
    }
    for text, want in found.items():
        base, added = semi_crf.find(text, crf)
        assert semi_crf.told(base + added) == ",".join(want)


def test_personal_data_rows(odd_rows, no_rows, crf):
    rows = {r.doc_id: r for r in semi_crf.mark(odd_rows, crf).collect()}
    assert rows[1].spans == rows[2].spans == "" and rows[7].n_email == rows[7].n_ip == rows[7].n_phone == 1
    clean = {r.doc_id: r.text for r in semi_crf.redact(odd_rows, crf).collect()}
    assert clean[1] is None and clean[7].startswith("mail <email>, <ip> or <phone>")
    assert semi_crf.redact(odd_rows, crf).columns == odd_rows.columns
    assert semi_crf.train(no_rows).weights and semi_crf.mark(no_rows, crf).count() == 0


def test_language_held_out(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    held = bucket_of("doc_id", 4) == 2
    model = language_id.train(docs, ~held)
    rows = language_id.identify(docs.where(held), model).collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 30 and right / len(rows) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_rows(odd_rows, no_rows):
    model = language_id.train(odd_rows, F.lit(True))
    rows = language_id.identify(odd_rows, model).collect()
    assert len(rows) == 10 and {r.lang_pred for r in rows if not (r.text or "").strip()} == {"und"}
    assert "source" in rows[0].asDict()
    empty = language_id.train(no_rows, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd_rows, empty).collect()} == {"und"}


def test_no_letter_is_undetermined(spark):
    texts = [("½ ²", "de"), ("Ⅷ 1 _", "de"), ("ein Wort", "de"), ("a word", "en"), ("слово", "ru")]
    docs = spark.createDataFrame(texts, "text string, lang string")
    got = [r.lang_pred for r in language_id.identify(docs, language_id.train(docs, F.lit(True))).collect()]
    assert got[:2] == ["und", "und"] and "und" not in got[2:]


def test_many_languages(spark, monkeypatch):
    """Each of 300 languages is learned, also where weights share slots."""
    draw = random.Random(8)
    words = {f"l{k:03}": ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(4)] for k in range(300)}
    rows = [(" ".join(draw.choices(w, k=12)), lang) for lang, w in words.items() for _ in range(6)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    for slots in (language_id.SLOTS, 1 << 21):
        monkeypatch.setattr(language_id, "SLOTS", slots)
        model = language_id.train(docs, F.lit(True))
        assert len(model.languages) == 300 and len(model.weights) <= slots
        names, _ = model.predict([" ".join(w) for w in words.values()])
        assert sum(a == b for a, b in zip(names, words)) >= 285


def test_leader_by_definition():
    """Weights against the plain per-coordinate rule on dense rows."""
    draw = np.random.default_rng(4)
    model = language_id.Model(["a", "b", "c"], np.ones(language_id.DIMENSIONS))
    rows = [(np.sort(draw.choice(40, 6, replace=False)), draw.random(6), int(draw.integers(3))) for _ in range(30)]
    language_id.leader(model, rows, epochs=2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i, c):
        if abs(z[i, c]) <= language_id.L1:
            return 0.0
        rate = (language_id.BETA + n[i, c] ** 0.5) / language_id.ALPHA + language_id.L2
        return -(z[i, c] - np.sign(z[i, c]) * language_id.L1) / rate

    for at, values, label in rows * 2:
        x = {**dict(zip(at.tolist(), values)), language_id.DIMENSIONS: 1.0}
        w = {(i, c): weight(i, c) for i in x for c in range(3)}
        e = np.exp([sum(v * w[i, c] for i, v in x.items()) for c in range(3)])
        p = e / e.sum()
        for i, v in x.items():
            for c in range(3):
                g = v * (p[c] - (c == label))
                sigma = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / language_id.ALPHA
                z[i, c] += g - sigma * w[i, c]
                n[i, c] += g * g
    got = model.weights[model.slots(np.arange(40))]
    want = [[weight(i, c) for c in range(3)] for i in [*range(40), language_id.DIMENSIONS]]
    assert np.allclose(got, want)


def test_document_frequencies(spark):
    texts = ["ab", "ab", "b", "é"]
    counts, n = language_id.document_frequencies(spark.createDataFrame([(t,) for t in texts], "t string"))
    want = np.zeros(language_id.DIMENSIONS, dtype=int)
    for t in texts:
        want[np.unique(language_id.buckets(t))] += 1
    assert n == 4 and (counts == want).all()


def subsequence_kernel(s, t):
    """The gap-weighted kernel of two short strings by definition."""
    import itertools

    def weights(x):
        out = collections.Counter()
        for at in itertools.combinations(range(len(x)), string_kernel.ORDER):
            span = at[-1] - at[0] + 1
            if span <= string_kernel.SPAN:
                out[tuple(x[i] for i in at)] += string_kernel.DECAY**span
        return out

    a, b = weights(s), weights(t)
    return sum(v * b[k] for k, v in a.items())


def test_kernel_by_definition():
    words = [string_kernel.letters(w) for w in ("idiot", "i-d.i o t", "idxiot", "pathetic", "sympathetic")]
    for s in words:
        for t in words:
            a, b = string_kernel.features(s), string_kernel.features(t)
            own = subsequence_kernel(s, s) ** 0.5 * subsequence_kernel(t, t) ** 0.5
            assert abs(sum(v * b.get(k, 0) for k, v in a.items()) - subsequence_kernel(s, t) / own) < 1e-9


def test_window_sums():
    draw = np.random.default_rng(1)
    weights = draw.normal(size=string_kernel.CODES)
    for n in (1, 5, 9, 10, 40):
        stream = draw.integers(1, 27, n).astype(np.int32)
        sums = string_kernel.window_sums(stream, weights)
        for i, got in enumerate(sums):
            part = stream[i : i + string_kernel.WINDOW]
            assert abs(got - sum(weights[c] @ np.full(len(c), w) if np.ndim(weights[c]) else 0 for c, _, w in string_kernel.codes(part))) < 1e-9


def test_toxic_words_and_gaps(spark):
    draw = random.Random(5)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to st io le is ou ar as de rt ve".split()
    def text(insult):
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(60)]
        if insult:
            for _ in range(2):
                words.insert(draw.randrange(60), draw.choice(["idiot", "worthless", "pathetic", "clown"]))
        return " ".join(words)

    model = string_kernel.fit([text(True) for _ in range(150)], [text(False) for _ in range(300)])
    toxic = np.array(model.score([text(True) for _ in range(60)])[0])
    clean = np.array(model.score([text(False) for _ in range(60)])[0])
    assert (toxic >= 0.3).mean() > 0.9 and (clean >= 0.3).mean() < 0.1
    spaced = model.score([text(False) + " w o r t h l e s s and p.a.t.h.e.t.i.c " + text(False)])[0]
    assert spaced[0] >= 0.3


def test_letters_of_all_scripts():
    plain = string_kernel.letters("idiot").tolist()
    for same in ("ｉｄｉｏｔ", "іdіоt", "𝐢𝐝𝐢𝐨𝐭", "1d!0t", "ÍDÌÓT"):
        assert string_kernel.letters(same).tolist() == plain
    for text in ("идиот дурак", "ηλίθιος", "أحمق", "笨蛋白痴", "멍청이"):
        stream = string_kernel.letters(text)
        assert len(stream) >= 3 and 1 <= stream.min() and stream.max() < string_kernel.LETTERS
    assert len(string_kernel.letters("123 … 😀 \U0001f4a9 ½")) == len(string_kernel.letters("1 3"))


def test_toxic_words_of_another_script():
    draw = random.Random(6)
    syllables = "ко ра ст но ен то ка ли пр ов на ре ве по ск ло ми те ни ва".split()

    def text(insult):
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(60)]
        if insult:
            words.insert(draw.randrange(60), draw.choice(["идиот", "мерзавец", "дурачьё"]))
        return " ".join(words)

    model = string_kernel.fit([text(True) for _ in range(150)], [text(False) for _ in range(300)])
    toxic = np.array(model.score([text(True) for _ in range(60)])[0])
    clean = np.array(model.score([text(False) for _ in range(60)])[0])
    assert (toxic >= 0.3).mean() > 0.8 and (clean >= 0.3).mean() < 0.2


def test_toxic_rows(odd_rows, no_rows):
    labelled = odd_rows.withColumn("toxic", (F.col("doc_id") == 7).cast("int"))
    rows = string_kernel.judge(odd_rows, string_kernel.train(labelled)).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    none = string_kernel.train(labelled.limit(0))
    assert max(r.score for r in string_kernel.judge(odd_rows, none).collect()) < 1e-9
    assert string_kernel.judge(no_rows, none).count() == 0
