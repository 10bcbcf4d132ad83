"""Column functions: codes, SKUs, hashes, text cleaning (survey F1-F27)."""

import hashlib

from pyspark.sql import functions as F

from batchtrace.functions import codes as C, hashing as H, text as TX


def one(spark, col, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_int_to_code_edges(spark):
    got = one(spark, C.int_to_code("n"), [(0,), (1,), (31,), (675,), (676,), (-1,)], "n long")
    assert got == ["AA", "AB", "BF", "ZZ", None, None]


def test_code_round_trip_all_values(spark):
    df = spark.range(0, 676).select(F.col("id").alias("n"))
    bad = df.where(C.code_to_int(C.int_to_code("n")) != F.col("n")).count()
    assert bad == 0


def test_code_to_int_normalises_and_rejects(spark):
    got = one(spark, C.code_to_int("s"), [(" ab ",), ("zz",), ("A1",), ("ABC",), (None,), ("Äb",)], "s string")
    assert got == [1, 675, None, None, None, None]


def test_format_sku_keeps_wide_sequence(spark):
    got = one(spark, C.format_sku("c", "s", "p"), [(1, 2, 25), (3, 12345, 7)], "c long, s long, p long")
    assert got == ["1_0002_25", "3_12345_7"]


def test_parse_sku_forms(spark):
    rows = spark.createDataFrame([("1_0002_25",), ("1000225",), ("12345",), ("1_2",), ("a_b_c",)], "s string") \
        .select(C.parse_sku("s").alias("p")).collect()
    assert (rows[0].p.category_code, rows[0].p.seq, rows[0].p.pack_size_value) == (1, 2, 25)
    assert (rows[1].p.category_code, rows[1].p.seq, rows[1].p.pack_size_value) == (1, 2, 25)
    assert rows[2].p.error == "sku too short"
    assert rows[3].p.error.startswith("sku format should be")
    assert rows[4].p.error == "sku parts must be integers"


def test_tokens_and_base_code(spark):
    df = spark.createDataFrame([("AB AC AD PP 260205",), ("AB AC",)], "c string")
    got = df.select(C.token("c", 2).alias("t"), C.parse_base_code("c").alias("b")).collect()
    assert got[0].t == "AD" and got[1].t is None
    assert got[1].b is None
    assert one(spark, C.parse_base_code("c"), [(" ab  ac ad ",)], "c string")[0].asDict() == \
        {"set_code": "AB", "weight_code": "AC", "batch_variant_code": "AD"}


def test_hashes_match_python(spark):
    df = spark.createDataFrame([(["b", "a", "a"], [("s2", "87.50"), ("s1", "12.50")], [("s2", "B2"), ("s1", "B1")])],
                               "skus array<string>, w array<struct<sku:string,wt_percent:string>>, "
                               "b array<struct<sku:string,ingredient_batch_code:string>>")
    df = df.withColumn("w", F.transform("w", lambda x: F.struct(x["sku"].alias("sku"),
                                                                x["wt_percent"].cast("decimal(9,2)").alias("wt_percent"))))
    r = df.select(H.hash_set("skus"), H.hash_weights("w"), H.hash_batches("b")).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert r[0] == sha("a|a|b")
    assert r[1] == sha("s1=12.50|s2=87.50")
    assert r[2] == sha("s1=B1|s2=B2")


def test_collapse_and_blank(spark):
    assert one(spark, TX.collapse_ws("c"), [(" AB   CD EF ",)], "c string") == ["AB CD EF"]
    assert one(spark, TX.blank_to_null("c"), [("   ",), (" x ",)], "c string") == [None, "x"]


def test_status_repair_and_email(spark):
    assert one(spark, TX.repair_status("c"), [(" Recieved ",), ("Planned",), (" ",)], "c string") == \
        ["Received", "Planned", None]
    assert one(spark, TX.normalize_email("c"), [("accounts.example.com: Bob@X.COM ",)], "c string") == ["bob@x.com"]


def test_percent_and_dates(spark):
    assert one(spark, TX.percent_display("x"), [(12.0,), (12.345,), (None,)], "x double") == ["12%", "12.35%", ""]
    assert one(spark, TX.yymmdd_label("c"), [("260205",), ("2602",)], "c string") == ["2026-02-05", None]
    assert one(spark, TX.yymmdd_valid_date("c"), [("240229",), ("240230",)], "c string") == [True, False]
    assert one(spark, TX.ts_display("c"), [("2026-02-05 10:11:12",), ("not a date",)], "c string") == \
        ["10:11:12  - 05/02/2026", "not a date"]


def test_link_allow_list(spark):
    got = one(spark, TX.is_allowed_link("c"),
              [("",), ("https://docs.google.com/x",), ("http://a.google.com/y",), ("ftp://docs.google.com",),
               ("https://example.com",), ("not a url",)], "c string")
    assert got == [True, True, True, False, False, False]


def test_misplaced_sku_repair(spark):
    df = spark.createDataFrame([([], "1_0001_10, 2_0002_20"), (["x"], "1_0001_10, 2_0002_20"), ([], "GP")],
                               "s array<string>, w string")
    skus, ws = TX.misplaced_sku_repair("s", "w")
    got = [(list(r[0]), r[1]) for r in df.select(skus, ws).collect()]
    assert got == [(["1_0001_10", "2_0002_20"], ""), (["x"], "1_0001_10, 2_0002_20"), ([], "GP")]


def test_json_row_and_document_path(spark):
    import datetime as dt
    df = spark.createDataFrame([("1_0001_10", dt.datetime(2026, 2, 5, 10, 11, 12), "my sheet.pdf")],
                               "sku string, ts timestamp_ntz, f string")
    r = df.select(TX.json_row("sku", "ts"), TX.document_path("msds", "sku", TX.safe_filename("f"))).first()
    assert r[0] == '{"sku":"1_0001_10","ts":"2026-02-05T10:11:12"}'
    assert r[1] == "msds/ingredients/1_0001_10/my_sheet.pdf"


def test_parse_iso_ts_utc_session(spark):
    import datetime as dt
    got = one(spark, TX.parse_iso_ts("c"), [("2026-02-05T10:00:00+02:00",), ("2026-02-05 10:00:00",), ("x",)],
              "c string")
    assert got == [dt.datetime(2026, 2, 5, 8, 0), dt.datetime(2026, 2, 5, 10, 0), None]
