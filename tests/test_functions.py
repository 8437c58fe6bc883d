"""Text and vector functions against fixed examples."""

import re
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vectors as V
from graphloom.operators import models, prompts
from graphloom.sources import web


def value(spark, column, **data):
    names = list(data)
    schema = ", ".join(f"{n} {'array<array<string>>' if isinstance(v, list) else 'string'}" for n, v in data.items())
    df = spark.createDataFrame([tuple(data.values())], schema) if names else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "made,given,want",
    [
        (T.clean_name, "Foo_(bar): Été 2.0 ", "Foo_bar Été 20"),
        (T.clean_name, "김 치!", "김 치"),
        (T.normalize_answer, "The U.S.A., an  Éa!", "usa éa"),
        (T.parse_answers, "x f_answers( [\"A\", 'B'] ) y", ["A", "B"]),
        (T.parse_answers, 'f_answers(["King\'s Lynn", "B"])', ["King", ","]),
        (T.parse_answers, "f_answers([])", []),
        (T.parse_answers, " plain ", ["plain"]),
        (T.percent_decode, "a+b%20c", "a+b c"),
        (T.percent_decode, "50%", "50%"),
        (T.prompt_cell, "1,000 x", "1 , 000 x"),
        (T.url_name, "http://x/y/A%20b.c.png?z=1", "A bc"),
        (T.url_extension, "http://x/y/A.PNG?z=1", "png"),
        (T.subqueries, "a; b\n;;  c ", ["a", "b", "c"]),
        (T.modality, " Table. ", "table"),
        (T.modality, "other", "text"),
        (T.tokens, "a b  c", ["a", "b", "c"]),
        (T.paragraphs, " \n", [" \n"]),
        (T.paragraphs, "", [" "]),
        (T.links, "x [[a]] [[b]]", ["a", "b"]),
        (models.clean_ocr, "ＡＢ 가-1\n!", "AB 가 1"),
    ],
)
def test_text(spark, made, given, want):
    assert value(spark, made(F.col("s")), s=given) == want


def test_tables(spark):
    table = [["Club", "G"], ["Real Madrid [[http://x/A.png]]", "2"], ["", "7"]]
    assert value(spark, T.flatten_table(F.col("t")), t=table) == "Club G [SEP] Real Madrid 2 [SEP] 7"
    assert value(spark, T.table_for_labels(F.col("t")), t=table) == "Club G Real Madrid 2 7"
    assert value(spark, T.table_subcomponents(F.col("t")), t=table) == [[table[0], table[1]], [table[0], table[2]]]
    assert "Club | G\nReal Madrid | 2" in value(spark, prompts.table_block(F.lit("T"), F.array(F.lit("s")), F.col("t")), t=table)


def test_table_blocks_take_time_in_proportion(spark):
    table = [[f"a {i} , b", None if i % 7 == 0 else f"[[u{i}]]c,d[[v]]", "[[z]] "] for i in range(4000)]
    table[10] = []
    want = [[c and re.sub(r"\s*,\s*", " , ", re.sub(r"\[\[.*?\]\]", "", c).strip()) for c in r] for r in table]
    want[3999][1] = "<Image 5> , " + want[3999][1]
    began = time.time()
    first = prompts.first_table_image(F.col("t"), F.col("there"))
    rows = spark.createDataFrame([(table, [f"u{i}" for i in range(3999, 40000)], 5), (table, ["w"], 5), (table, ["z"], None)], "t array<array<string>>, there array<string>, n int")
    made = rows.withColumn("first", first).select("first", prompts.table_block(F.lit("T"), F.array(F.lit("s")), F.col("t"), F.col("first"), F.col("n")).alias("b")).collect()
    assert time.time() - began < 20
    lines = lambda rows: "".join(" | ".join(c for c in r if c is not None) + "\n" for r in rows)
    assert [r.first for r in made] == ["u3999", None, "z"]
    assert made[0].b.split("\n\n", 1)[1] == lines(want) + "*/\n\n"
    want[3999][1] = want[3999][1].removeprefix("<Image 5> , ")
    assert all(r.b.split("\n\n", 1)[1] == lines(want) + "*/\n\n" for r in made[1:])


@pytest.mark.parametrize("size,want", [((1024, 768), (591, 443)), ((512, 512), (512, 512)), ((300, 200), (300, 200))])
def test_scaled_size(spark, size, want):
    assert tuple(spark.range(1).select(T.scaled_size(F.lit(size[0]), F.lit(size[1])).alias("v")).first().v) == want


def test_boxes(spark):
    box = lambda *b: spark.range(1).select(T.clamped_box(F.array(*map(F.lit, b)), F.lit(10), F.lit(8)).alias("v")).first().v
    assert box(-3, 2, 20, 20) == [0, 2, 10, 8] and box(5, 5, 5, 9) is None


def test_late_interaction(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]], [[0.0, 2.0]])], "q array<array<float>>, a array<array<float>>, b array<array<float>>")
    ma, mb = (V.best_per_subquery(F.col("q"), F.col(c)) for c in "ab")
    r = df.select(V.total(ma).alias("s"), V.pair_total(ma, mb).alias("p"), V.pair_total(ma, F.lit(None).cast("array<double>")).alias("n"), V.total(F.lit(None).cast("array<double>")).alias("z")).first()
    assert (r.s, r.p, r.n, r.z) == (1.0, 3.0, 1.0, -1.0)


def test_models_report_failures(spark):
    class Broken:
        def generate(self, prompts, images, max_tokens):
            raise OSError("down")

    row = spark.range(1).select(models.generated(Broken(), F.lit("q")).alias("g")).first().g
    assert row.text == "[Generation Failed]" and row.error == "OSError: down"


def test_fetch_falls_back(spark):
    class Some:
        def fetch(self, url):
            if url.startswith("a:"):
                raise OSError("no")
            return url.encode()

    rows = web.fetched(spark.createDataFrame([("x",)], "url string"), Some(), ("a:{url}", "b:{url}")).collect()
    assert bytes(rows[0].content) == b"b:x" and rows[0].error is None


def test_answers_of_all_conversations_against_python(spark):
    import re
    import string

    from graphloom.plans import queries

    def brute(text):
        bare = "".join(c for c in text.lower() if c not in string.punctuation)
        return " ".join(re.sub(r"\b(a|an|the)\b", " ", bare).split())

    sf = "/root/testdata/sf0.01"
    want = [(r.conv_id, r.turn, None if r.text is None else brute(r.text)) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = [tuple(r) for r in queries.normalized_answers_all(spark, sf).collect()]
    assert len(got) == queries.normalized_answers(spark, sf).count() == len(want)
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
