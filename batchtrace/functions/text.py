"""Text, date and display column functions (F7-F11, F13-F27). All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from batchtrace.functions._util import col


def collapse_ws(c) -> Column:
    """trim and collapse whitespace runs to one space: ' AB   CD EF ' -> 'AB CD EF'."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def blank_to_null(c) -> Column:
    """F8: trimmed text, or NULL when blank."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def norm_code(c) -> Column:
    """lookup-code normalisation (trim + upper)."""
    return F.upper(F.trim(col(c)))


def is_yymmdd(c) -> Column:
    """exactly six digits."""
    return F.coalesce(col(c).rlike("^[0-9]{6}$"), F.lit(False))


def to_yymmdd(ts) -> Column:
    """timestamp/date -> 'yyMMdd', built from the wall-clock fields (independent of the
    session time zone, unlike ``date_format`` on a local-time conversion)."""
    ts = col(ts)
    return F.format_string("%02d%02d%02d", F.year(ts) % 100, F.month(ts), F.dayofmonth(ts))


def yymmdd_label(c) -> Column:
    """'yyMMdd' -> '20yy-mm-dd' (NULL unless six digits)."""
    c = col(c)
    return F.when(is_yymmdd(c), F.concat(F.lit("20"), F.substring(c, 1, 2), F.lit("-"), F.substring(c, 3, 2),
                                         F.lit("-"), F.substring(c, 5, 2)))


def yymmdd_valid_date(c) -> Column:
    """six digits that form a real calendar date (2024-02-30 is rejected)."""
    return F.try_to_timestamp(F.concat(F.lit("20"), col(c)), F.lit("yyyyMMdd")).isNotNull() & is_yymmdd(c)


def ts_display(c) -> Column:
    """'HH:mm:ss  - dd/MM/yyyy'; text that does not parse as a timestamp is kept as is."""
    c = col(c)
    # Wall-clock fields of a timestamp_ntz value: independent of the session time zone.
    w = c.cast("string").try_cast("timestamp_ntz")
    text = F.format_string("%02d:%02d:%02d  - %02d/%02d/%04d", F.hour(w), F.minute(w), F.second(w),
                           F.dayofmonth(w), F.month(w), F.year(w))
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit("")).otherwise(
        F.when(w.isNotNull(), text).otherwise(c.cast("string")))


def percent_display(c) -> Column:
    """whole numbers as 'N%', others with two decimals 'N.NN%'; NULL -> ''."""
    x = col(c).cast("double")
    return (F.when(x.isNull(), F.lit(""))
            .when(x == F.floor(x), F.concat(F.floor(x).cast("string"), F.lit("%")))
            .otherwise(F.format_string("%.2f%%", x)))


def round_weight(c) -> Column:
    """F15 (native): round to 2 dp HALF_UP on the decimal value -> decimal(9,2).

    For double inputs with binary ties (1.005, 2.675) this differs from rounding the
    exact binary value; ``functions.udfs.round_weight_exact`` gives that form."""
    return F.round(col(c).cast("decimal(38,9)"), 2).cast("decimal(9,2)")


def array_size(c) -> Column:
    """ARRAY_LENGTH (NULL for a NULL array)."""
    c = col(c)
    return F.when(c.isNotNull(), F.size(c))


def json_text(c) -> Column:
    """JSON text of an array/struct (used as search text, quirk K4)."""
    return F.to_json(col(c))


# Hosts accepted for machine-setup / processed-data links.
ALLOWED_LINK_HOSTS = ["drive.google.com", "docs.google.com", "sheets.google.com"]
ALLOWED_LINK_SUFFIX = ".google.com"


def is_allowed_link(c) -> Column:
    """empty is allowed; else http/https and a Google Drive/Docs host."""
    c = col(c)
    scheme = F.lower(F.try_parse_url(c, F.lit("PROTOCOL")))
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    ok = scheme.isin("http", "https") & (host.isin(*ALLOWED_LINK_HOSTS) | host.endswith(ALLOWED_LINK_SUFFIX))
    return F.when(c.isNull() | (c == ""), F.lit(True)).otherwise(F.coalesce(ok, F.lit(False)))


def repair_status(c) -> Column:
    """legacy spelling 'Recieved' -> 'Received' (after trimming), blank -> NULL."""
    t = blank_to_null(c)
    return F.when(t == "Recieved", F.lit("Received")).otherwise(t)


def safe_filename(c) -> Column:
    """basename of a path with spaces replaced by '_'."""
    return F.translate(F.regexp_extract(col(c), r"([^/\\]*)$", 1), " ", "_")


def document_path(kind: str, *parts) -> Column:
    """object path of a stored document, e.g. msds/ingredients/<sku>/<file>."""
    prefix = {"msds": "msds/ingredients", "spec": "specs"}[kind]
    return F.concat_ws("/", F.lit(prefix), *[col(p) for p in parts])


def json_row(*cols) -> Column:
    """JSON-safe row text: ISO timestamps, decimals as numbers, nested values kept."""
    return F.to_json(F.struct(*[col(c) for c in cols]),
                     {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"})


def normalize_email(c) -> Column:
    """strip an identity-provider prefix before the first ':', trim, lower."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"^[^:]*:", "")))


def parse_iso_ts(c) -> Column:
    """ISO timestamp text -> UTC timestamp_ntz. Naive text is UTC; offsets are converted."""
    c = col(c)
    aware = F.try_to_timestamp(c)  # uses the session time zone (UTC) for naive text
    return F.when(aware.isNotNull(), F.to_timestamp_ntz(F.date_format(aware, "yyyy-MM-dd HH:mm:ss.SSSSSS")))


# A misplaced SKU token looks like digit_4digits_2digits.
SKU_TOKEN_PATTERN = r"\d_\d{4}_\d{2}"


def split_list(c, sep: str = ",") -> Column:
    """Comma list -> trimmed non-empty tokens."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), sep), lambda x: F.trim(x)),
                    lambda x: x != "")


def misplaced_sku_repair(sku_list, workstream) -> tuple[Column, Column]:
    """when sku_list is empty and workstream holds >= 2 comma tokens that all look like
    SKUs, move them to sku_list and blank the workstream. Returns (sku_list, workstream)."""
    skus = F.filter(F.coalesce(col(sku_list), F.array().cast("array<string>")),
                    lambda x: x.isNotNull() & (x != ""))
    toks = split_list(workstream)
    move = (F.size(skus) == 0) & (F.size(toks) > 1) & F.forall(toks, lambda x: x.rlike(SKU_TOKEN_PATTERN))
    return (F.when(move, toks).otherwise(col(sku_list)),
            F.when(move, F.lit("")).otherwise(col(workstream)))


def partner_label(partner_name, machine) -> Column:
    """'partner - machine' with fallbacks to whichever part is present."""
    p, m = blank_to_null(partner_name), blank_to_null(machine)
    return F.coalesce(F.concat(p, F.lit(" - "), m), p, m)


def partner_machine_label(partner_name, machine) -> Column:
    """'partner (machine)' or just the partner."""
    p, m = blank_to_null(partner_name), blank_to_null(machine)
    return F.coalesce(F.concat(p, F.lit(" ("), m, F.lit(")")), p)


def option_key(code, machine) -> Column:
    """option key 'code||machine'; NULL (dropped) when either part is blank."""
    c, m = blank_to_null(code), blank_to_null(machine)
    return F.concat(c, F.lit("||"), m)


def default_text(c, default: str = "Unknown") -> Column:
    """blank/NULL -> default."""
    return F.coalesce(blank_to_null(c), F.lit(default))
