"""The one-pass scanner against the single column functions and known cases."""

import random
import time

from pyspark.sql import functions as F

from tarnwork.functions import metadata as M
from tarnwork.functions.defaults import AUTHORITIES, CATEGORIES
from tarnwork.functions.scan import FIELDS, Scanner

NOTICE = "关于加强融资支持的通知\n财金〔2026〕15号\n财政部\n各省、自治区财政厅：\n自2026年4月1日起施行，有效期至2027年12月31日。\n财政部\n2026年3月15日"


def texts(seed, n):
    r = random.Random(seed)
    parts = [*AUTHORITIES, *(w for words in CATEGORIES.values() for w in words), "\n", "\n", "\r\n", " ", "，", "文", "〔2024〕12号", "[2023]7号", "2024年 3 月5日", "2020年12月31日止", "2019年1月2日", "自2021年2月3日起实施", "自2022年2月3日起执行", "有效期", "有效期至2030年1月1日", "执行至2031年1月1日", "浙江省", "全国", "发布来源：某处", "关于", "办法", "字" * 400]
    return [None, "", " \n\t", NOTICE] + ["".join(r.choices(parts, k=r.randrange(1, 40))) for _ in range(n)]


def test_fields_equal_the_column_functions(spark):
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts(1, 400))], "id int, text string, title string").repartition(3)
    got = M.extract_metadata(rows.drop("title").withColumn("other", F.lit(1)))
    assert got.columns == ["id", "text", "other", *FIELDS]
    c = "text"
    single = {"policy_number": M.policy_number(c), "issuing_authority": M.issuing_authority(c), "publish_date": M.publish_date(c), "effective_date": M.effective_date(c), "expiry_date": M.expiry_date(c), "applicable_region": M.applicable_region(c), "title": M.guess_title(c)}
    single["category"] = F.when(F.col(c).isNotNull(), M.classify_category(F.lit(""), c))
    want = {r["id"]: r for r in rows.select("id", *(e.alias(f) for f, e in single.items())).collect()}
    for r in got.collect():
        for f in FIELDS:
            assert r[f] == want[r["id"]][f], (f, r["text"])


def test_known_notice_and_other_lists(spark):
    scan = Scanner()
    assert dict(zip(FIELDS, scan.fields(NOTICE))) == {
        "title": "关于加强融资支持的通知", "policy_number": "财金〔2026〕15号", "issuing_authority": "财政部", "publish_date": "2026-03-15", "effective_date": "2026-04-01",
        "expiry_date": "2027-12-31", "applicable_region": "全国", "category": "融资支持",
    }
    own = Scanner(names=["ab", "abc", "b"], categories={"x": ["ab", "q"], "y": ["abc", "ab"]}, title_words=[], other="none")
    got = dict(zip(FIELDS, own.fields("zz abc q")))
    assert got["issuing_authority"] == "ab" and got["category"] == "x" and got["title"] is None
    assert own.fields("nothing")[-1] == "none" and own.fields(None) == (None,) * len(FIELDS)
    rows = spark.createDataFrame([("zz abc", "old")], "text string, category string")
    assert M.extract_metadata(rows, names=["abc"], categories={"x": ["zz"]}).first().asDict()["category"] == "x"
    assert M.extract_metadata(rows.limit(0)).count() == 0


def test_very_long_texts_take_linear_time():
    scan, began = Scanner(), time.time()
    for text in ("有效期" * 300_000, "有效期2024年1月1日" * 80_000, "自2024年1月1日起" * 80_000, "字" * 1_000_000, "\n" * 1_000_000, "2024年1月" * 150_000, "有效期\n" * 250_000):
        scan.fields(text)
    assert time.time() - began < 20
