"""Checks of source settings; the first that fails names the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linefold.functions.infer import WHOLE_NUMBER
from linefold.functions.values import strip

# Checked columns in order, and the messages.
REQUIRED = ["source_name", "source_ip", "listener_port", "target_type"]
PORT_RANGE = "Listener port must be between 1 and 65535"
PORT_NUMBER = "Listener port must be a valid number"
PROTOCOL = "Protocol must be either UDP or TCP"
FOLDER_PATH = "Folder path is required for Folder target"
COMPRESSION_FLAG = "compression_enabled must be a boolean value"
LEVEL_RANGE = "Compression level must be between 1 and 9"
LEVEL_NUMBER = "Compression level must be a valid integer"
HEC_URL = "HEC URL is required for HEC Connector target"
HEC_TOKEN = "HEC token is required for HEC Connector target"
TARGET = "Target type must be either FOLDER or HEC"
BAD_ADDRESS = "Invalid IP address. Please enter a valid IPv4 address."
BAD_URL = "Invalid URL. Please enter a valid URL starting with http:// or https://."


def _whole(text: Column) -> Column:
    return F.replace(strip(text), F.lit("_"), F.lit("")).try_cast("decimal(38,0)")


def _range_errors(name: str, low: int, high: int, not_number: str, outside: str) -> list[Column]:
    text = F.col(name).cast("string")
    return [
        F.when(~strip(text).rlike(WHOLE_NUMBER), F.lit(not_number)),
        # A number too long for the type is outside as well.
        F.when(text.isNotNull() & ~F.coalesce(_whole(text).between(low, high), F.lit(False)), F.lit(outside)),
    ]


def source_error(columns: list[str]) -> Column:
    """Message of the first failing check, or null. Null and absent columns count as unset."""

    def given(name: str) -> Column:
        return F.col(name).isNotNull() if name in columns else F.lit(False)

    def require(name: str, message: str, when: Column) -> Column:
        return F.when(when & ~given(name), F.lit(message))

    folder = F.col("target_type") == "FOLDER"
    hec = F.col("target_type") == "HEC"
    checks = [require(n, f"Missing required field: {n}", F.lit(True)) for n in REQUIRED]
    checks += _range_errors("listener_port", 1, 65535, PORT_NUMBER, PORT_RANGE)
    checks.append(
        F.when(~F.coalesce(F.col("protocol").isin("UDP", "TCP"), F.lit(False)), F.lit(PROTOCOL))
        if "protocol" in columns
        else F.lit(PROTOCOL)
    )
    checks.append(require("folder_path", FOLDER_PATH, folder))
    if "compression_enabled" in columns:
        flag = F.lower(F.col("compression_enabled").cast("string"))
        checks.append(F.when(folder & ~flag.isin("true", "false"), F.lit(COMPRESSION_FLAG)))
    if "compression_level" in columns:
        checks += [
            F.when(folder, error)
            for error in _range_errors("compression_level", 1, 9, LEVEL_NUMBER, LEVEL_RANGE)
        ]
    checks.append(require("hec_url", HEC_URL, hec))
    checks.append(require("hec_token", HEC_TOKEN, hec))
    checks.append(F.when(~folder & ~hec, F.lit(TARGET)))
    return F.coalesce(*checks)


def validate_sources(sources: DataFrame) -> DataFrame:
    """``source_id, valid, error`` for every row."""
    return sources.select("source_id", source_error(sources.columns).alias("error")).select(
        "source_id", F.col("error").isNull().alias("valid"), "error"
    )


def address_error(source_ip: Column, hec_url: Column) -> Column:
    """Entry checks of an address and a URL: IPv4 octets and the URL scheme."""
    octets = F.split(source_ip, "\\.")
    good_ip = (F.size(octets) == 4) & F.forall(
        octets, lambda o: o.rlike("^\\d{1,3}$") & (o.try_cast("int") <= 255)
    )
    good_url = F.startswith(hec_url, F.lit("http://")) | F.startswith(hec_url, F.lit("https://"))
    return F.when(~good_ip, F.lit(BAD_ADDRESS)).when(~good_url, F.lit(BAD_URL))
