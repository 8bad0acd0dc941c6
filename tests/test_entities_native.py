import html
import re

from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scalars as S
from tidewire.operators import edition as E
from tidewire.operators import views as V

ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});", re.A)


def decoded(text):
    def one(m):
        said = m[1]
        if said[0] == "#":
            point = int(said[2:], 16) if said[1] in "xX" else int(said[1:])
            return chr(point) if 1 <= point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF else m[0]
        return C.ENTITIES.get(said.lower(), m[0])

    return ENTITY.sub(one, text)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entities_are_those_of_one_pass(spark):
    points = [1, 9, 10, 13, 15, 16, 38, 65, 127, 128, 255, 0x7FF, 0x800, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F525, 0x3FFFF, 0x40000, 0xFFFFF, 0x100000, 0x10FFFF, 0x110000, 9999999]
    texts = [f"a&#{p};b&#x{p:x};&#X{p:X};" for p in points] + [f"&{n};&{n.upper()};&{n}&amp;{n};" for n in C.ENTITIES]
    texts += ["&", "&&", "&;", "&#;", "&#x;", "&&amp;&", "&amp&amp;", "a&\n&lt;\r\n&gt;", "&#00000065;", "&#0000065;", "&#x0000041;", "&#x00041;", "&#-1;", "&a;", "&ab;", "&" + "a" * 32 + ";", "&" + "a" * 33 + ";", "ü&AMP;😀&#x1F525;é", "&٣;&#٣;", "&#38;#38;", "$1\\&quot;", "&am p;", "x" * 70_000 + "&amp;" + "&lt;y" * 5_000, html.escape("<a href='b'>&amp;</a>"), "&"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    got = dict(rows.select("k", S.decode_entities("x")).collect())
    assert [got[k] for k in range(len(texts))] == [decoded(x) for x in texts]


def test_an_edition_is_windowed_without_python(spark, tmp_path):
    """Every decode had its own workers, three of them in a task: one of the filter, two of the rows that it left."""
    spark.createDataFrame([("s", 1, "a &amp; b", "https://e.org/", "2024-01-31T00:00:00Z", None, "t")], "source_id string, pos long, title string, link string, iso_date string, pub_date string, snippet string").write.parquet(f"{tmp_path}/items")
    spark.createDataFrame([("s", 0, "Feed", "Government", "cert", 3, None)], "source_id string, source_pos int, name string, tier string, source_type string, max_items int, title_include string").write.parquet(f"{tmp_path}/sources")
    rows = E.source_window(E.normalize(spark.read.parquet(f"{tmp_path}/items"), spark.read.parquet(f"{tmp_path}/sources")), 1706745600000)
    assert [r["title"] for r in rows.collect()] == ["a & b"]
    assert "Python" not in plan(rows)


def test_feeds_are_rows_without_python(spark):
    feeds = V.feeds_df(spark)
    assert [tuple(r) for r in feeds.collect()] == V.feeds()
    assert feeds.schema.simpleString() == "struct<slug:string,feed_title:string,min_rank:int,feed_section:string>"
    assert "ExistingRDD" not in plan(feeds)
    assert feeds.where(F.col("slug") == "none").isEmpty()
