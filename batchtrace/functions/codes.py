"""Code and SKU column functions (F1-F6, F12). All are JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from batchtrace.functions._util import col

# Two-letter codes use the 26 letters A-Z, so one scope holds 26 * 26 = 676 codes.
CODE_SPACE = 676


def int_to_code(n, strict: bool = False) -> Column:
    """0 -> 'AA', 1 -> 'AB', 675 -> 'ZZ'. Outside 0..675 gives NULL, or raises when strict."""
    n = col(n).cast("long")
    code = F.concat(_char(F.lit(65) + F.floor(n / 26)), _char(F.lit(65) + F.pmod(n, F.lit(26))))
    ok = n.between(0, CODE_SPACE - 1)
    if strict:
        return F.when(ok, code).otherwise(F.raise_error(F.concat(F.lit("code value out of range: "),
                                                                  n.cast("string"))))
    return F.when(ok, code)


def _char(n: Column) -> Column:
    return F.call_function("char", n.cast("long"))


def code_to_int(s) -> Column:
    """trim, upper, exactly two ASCII letters -> 0..675, else NULL."""
    c = F.upper(F.trim(col(s)))
    return F.when(c.rlike("^[A-Z]{2}$"),
                  (F.ascii(c) - 65) * 26 + (F.ascii(F.substring(c, 2, 1)) - 65)).cast("long")


def is_two_letter_code(s) -> Column:
    """two ASCII upper-case letters (stricter than str.isalpha)."""
    return F.coalesce(col(s).rlike("^[A-Z]{2}$"), F.lit(False))


def format_sku(category, seq, pack) -> Column:
    """``<category>_<seq:04d>_<pack>``. Never a bare lpad: a 5-digit seq keeps all digits."""
    c, s, p = (col(x).cast("long") for x in (category, seq, pack))
    # a format string is parsed for every row: only NULL and negative numbers take that way
    digits = F.when(s >= 1000, s.cast("string")).when(s >= 0, F.lpad(s.cast("string"), 4, "0"))
    plain = F.concat(c.cast("string"), F.lit("_"), digits, F.lit("_"), p.cast("string"))
    return F.coalesce(plain, F.format_string("%d_%04d_%d", c, s, p))


def parse_sku(s) -> Column:
    """struct<category_code, seq, pack_size_value, error>.

    ``c_s_p`` form: exactly three ``_`` separated integers. Legacy form (no ``_``):
    category = first char, seq = chars 2-5, pack = the rest, length >= 6.
    Invalid text gives NULL numbers and an error message."""
    s = col(s)
    parts = F.split(s, "_")
    underscored = F.instr(s, "_") > 0
    three = F.size(parts) == 3
    cat_u, seq_u, pack_u = (F.get(parts, i).try_cast("long") for i in range(3))
    cat_l = F.substring(s, 1, 1).try_cast("long")
    seq_l = F.substring(s, 2, 4).try_cast("long")
    pack_l = F.substring(s, 6, 1 << 30).try_cast("long")
    cat = F.when(underscored, F.when(three, cat_u)).otherwise(F.when(F.length(s) >= 6, cat_l))
    seq = F.when(underscored, F.when(three, seq_u)).otherwise(F.when(F.length(s) >= 6, seq_l))
    pack = F.when(underscored, F.when(three, pack_u)).otherwise(F.when(F.length(s) >= 6, pack_l))
    err = (F.when(s.isNull(), F.lit("sku is required"))
           .when(underscored & ~three, F.lit("sku format should be <category>_<seq>_<pack_size>"))
           .when(~underscored & (F.length(s) < 6), F.lit("sku too short"))
           .when(cat.isNull() | seq.isNull() | pack.isNull(), F.lit("sku parts must be integers")))
    ok = err.isNull()
    return F.struct(F.when(ok, cat).alias("category_code"), F.when(ok, seq).alias("seq"),
                    F.when(ok, pack).alias("pack_size_value"), err.alias("error"))


def seq4(n) -> Column:
    """zero-padded 4-digit sequence token (wider numbers keep all digits)."""
    return F.format_string("%04d", col(n).cast("long"))


def token(code, i: int) -> Column:
    """safe token access: the i-th space-separated token or NULL when out of range."""
    return F.get(F.split(col(code), " "), i)


def code_tokens(code) -> Column:
    """The space-separated tokens of a composite code, as stored with pellet bags."""
    return F.split(col(code), " ")


def base_code(set_code, weight_code, variant_code) -> Column:
    """``set weight variant``; NULL if any part is NULL (null-propagating concat)."""
    return F.concat(col(set_code), F.lit(" "), col(weight_code), F.lit(" "), col(variant_code))


def parse_base_code(s) -> Column:
    """a base code is exactly three non-blank tokens; upper-cased. Struct or NULL."""
    toks = F.filter(F.split(F.trim(col(s)), r"\s+"), lambda x: x != "")
    up = F.transform(toks, lambda x: F.upper(x))
    return F.when(F.size(up) == 3, F.struct(F.get(up, 0).alias("set_code"), F.get(up, 1).alias("weight_code"),
                                           F.get(up, 2).alias("batch_variant_code")))
