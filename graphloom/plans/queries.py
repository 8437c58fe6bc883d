"""The registered queries over whole tables, with their DuckDB oracles side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Retrieval, tuned
from ..functions import text as T
from ..operators import evaluation, graph, html, labelling, models, prompts
from ..operators.knn import dense_topk
from ..sources.readers import image_metadata
from ..sources.sinks import still_to_do
from . import fixtures
from ..tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c) -> F.Column:  # noqa: ANN001
    return F.round(c, 6)


# ---------------------------------------------------------------- dense search

_KNN = """
  q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 50 = 0),
  s AS (SELECT q.qid, q.label AS q_label, c.vec_id AS component_id, c.label, list_dot_product(q.v, c.embedding::DOUBLE[]) AS score
        FROM q, embeddings c),
  knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, component_id) AS rank FROM s) WHERE rank <= 9)"""


@query(f"WITH {_KNN} SELECT qid, component_id, round(score, 6) AS score, rank FROM knn")
def knn_top9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense_topk(fixtures.questions(spark, sf_dir), fixtures.components(spark, sf_dir), 9)
    return found.select("qid", "component_id", _r("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def _knn_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(`qid`, `gold`, `found`): components of the question's label, and the nine nearest in order."""
    comps, asked = fixtures.components(spark, sf_dir), fixtures.questions(spark, sf_dir)
    near = dense_topk(asked, comps, 9).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "component_id"))).alias("r"))
    gold = comps.groupBy("label").agg(F.collect_list("component_id").alias("gold"))
    return asked.select("qid", "label").join(gold, "label").join(near, "qid").select("qid", "gold", F.col("r.component_id").alias("found"))


@query(
    f"""WITH {_KNN}, t AS (SELECT label, list(vec_id) AS gold FROM embeddings GROUP BY label),
    j AS (SELECT qid, any_value(gold) AS gold, list(component_id ORDER BY rank) AS found FROM knn JOIN t ON t.label = q_label GROUP BY qid)
    SELECT count(*) AS n, count_if(list_has_any(gold, found)) AS exists_n, avg(list_has_any(gold, found)::INT) AS exists_rate,
           count_if(list_has_all(found, gold)) AS perfect_n, avg(list_has_all(found, gold)::INT) AS perfect_rate FROM j"""
)
def knn_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.match_rates(_knn_lists(spark, sf_dir))


@query(
    f"""WITH {_KNN}, g AS (SELECT qid, min(rank) FILTER (WHERE label = q_label) AS r FROM knn GROUP BY qid)
    SELECT count(*) AS n, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM g"""
)
def eval_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_reciprocal_rank(_knn_lists(spark, sf_dir)).select("n", _r("mrr").alias("mrr"))


# ---------------------------------------------------------------- late interaction and the graph

_M = """
  q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
  parts AS (SELECT vec_id, i, list_slice(embedding::DOUBLE[], 1 + 16 * i, 16 + 16 * i) AS p FROM embeddings, range(4) t(i)),
  mi AS (SELECT a.vec_id AS qid, b.vec_id AS component_id, a.i, max(list_dot_product(a.p, b.p)) AS x
         FROM parts a, parts b WHERE a.vec_id % 50 = 0 GROUP BY ALL),
  m AS (SELECT qid, component_id, list(x ORDER BY i) AS m, sum(x) AS s, max(x) AS best FROM mi GROUP BY ALL)"""


@query(f"WITH {_M} SELECT qid, component_id, round(s, 6) AS score FROM m")
def maxsim_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.all_totals(fixtures.sub_vectors(spark, sf_dir), fixtures.sub_queries(spark, sf_dir), digits=6)
    return found.select("qid", "component_id", _r("score").alias("score"))


@query(
    f"""WITH {_M} SELECT a.qid, a.component_id AS lo, b.component_id AS hi,
      round(list_sum(list_transform(range(1, 5), lambda i: greatest(a.m[i], b.m[i]))), 6) AS score
    FROM m a JOIN m b ON a.qid = b.qid AND b.component_id = a.component_id + 1"""
)
def maxsim_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = fixtures.sub_vectors(spark, sf_dir)
    ids = subs.select(F.col("component_id").alias("lo")).distinct()
    pairs = ids.join(ids.select((F.col("lo") - 1).alias("lo"), F.col("lo").alias("hi")), "lo")
    found = graph.all_pair_totals(pairs, subs, fixtures.sub_queries(spark, sf_dir), digits=6)
    return found.select("qid", "lo", "hi", _r("score").alias("score"))


_ENTRY = f"""{_M},
  dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d DESC, component_id) AS dr FROM
            (SELECT q.qid, c.vec_id AS component_id, list_dot_product(q.v, c.embedding::DOUBLE[]) AS d FROM q, embeddings c)),
  entry AS (SELECT * FROM (SELECT qid, component_id, row_number() OVER (PARTITION BY qid ORDER BY best DESC, dr) - 1 AS pos
            FROM dense JOIN m USING (qid, component_id) WHERE dr <= 2048) WHERE pos < 30)"""


@query(f"WITH {_ENTRY} SELECT qid, pos, component_id FROM entry")
def entry_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.find_entry(
        fixtures.questions(spark, sf_dir), fixtures.components(spark, sf_dir), fixtures.sub_vectors(spark, sf_dir), fixtures.sub_queries(spark, sf_dir)
    )
    return found.select("qid", F.col("pos").cast("long").alias("pos"), "component_id")


@query(f"WITH {_KNN.replace('<= 9', '<= 30')} SELECT qid, rank - 1 AS pos, component_id FROM knn")
def dense_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.dense_entry(fixtures.questions(spark, sf_dir), fixtures.components(spark, sf_dir))
    return found.select("qid", F.col("pos").cast("long").alias("pos"), "component_id")


_EDGES = """
  c AS (SELECT vec_id AS id, vec_id // 5 AS doc, CASE WHEN vec_id % 3 = 0 THEN (vec_id * 7 + 3) % (SELECT CAST(ceil(count(*) / 5) AS BIGINT) FROM embeddings) END AS link FROM embeddings),
  edges AS (SELECT a.id AS src, b.id AS dst FROM c a JOIN c b ON a.doc = b.doc UNION SELECT a.id, b.id FROM c a JOIN c b ON a.link = b.doc)"""


@query(f"WITH {_EDGES} SELECT src, dst FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_edges(fixtures.components(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT src, count(*) AS degree FROM edges GROUP BY src")
def edge_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_edges(fixtures.components(spark, sf_dir)).groupBy("src").agg(F.count("*").alias("degree"))


@query(
    f"""WITH {_ENTRY}, {_EDGES},
    pr AS (SELECT DISTINCT qid, least(component_id, dst) AS lo, greatest(component_id, dst) AS hi FROM entry JOIN edges ON src = component_id),
    sc AS (SELECT pr.*, a.s AS sl, b.s AS sh, list_sum(list_transform(range(1, 5), lambda i: greatest(a.m[i], b.m[i]))) AS p
           FROM pr JOIN m a ON a.qid = pr.qid AND a.component_id = lo JOIN m b ON b.qid = pr.qid AND b.component_id = hi),
    co AS (SELECT qid, CASE WHEN p > greatest(sl, sh) + 1e-5 OR sl >= sh THEN lo ELSE hi END AS el,
                  CASE WHEN p > greatest(sl, sh) + 1e-5 OR sl < sh THEN hi ELSE lo END AS eh,
                  CASE WHEN p > greatest(sl, sh) + 1e-5 THEN p ELSE greatest(sl, sh) END AS score FROM sc),
    en AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, el, eh) AS e FROM (SELECT qid, el, eh, max(score) AS score FROM co GROUP BY ALL)),
    me AS (SELECT en.qid, e, -m.s AS o, m.component_id AS c FROM en JOIN m ON m.qid = en.qid AND m.component_id IN (el, eh)),
    fi AS (SELECT qid, c, min(e) AS e, arg_min(o, e) AS o FROM me GROUP BY ALL),
    ke AS (SELECT *, count(*) OVER (PARTITION BY qid ORDER BY e RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM fi)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY e, o, c) - 1 AS pos, c AS component_id FROM ke WHERE n < 30"""
)
def one_hop_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Retrieval(max_hop=1)
    comps, subs, asked = fixtures.components(spark, sf_dir), fixtures.sub_vectors(spark, sf_dir), fixtures.sub_queries(spark, sf_dir)
    entry = graph.find_entry(fixtures.questions(spark, sf_dir), comps, subs, asked, settings)
    beam = graph.multi_hop(entry, graph.build_adjacency(comps), subs, asked, settings)
    return beam.select("qid", F.col("pos").cast("long").alias("pos"), "component_id")


@query()
def multi_hop_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = fixtures.components(spark, sf_dir)
    found = graph.retrieve(
        fixtures.questions(spark, sf_dir), comps, fixtures.sub_vectors(spark, sf_dir), fixtures.sub_queries(spark, sf_dir), graph.build_adjacency(comps)
    )
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "component_id")


# ---------------------------------------------------------------- labelling

_PUNCT = r"[.,!?;:\"()-]"
_TOKENS = "list_filter(string_split_regex(regexp_replace(text, '[.,!?;:\"()-]', ' ', 'g'), '\\s+'), lambda t: t <> '')"


@query(
    f"""WITH r AS (SELECT item_id AS ref_id, unnest({_TOKENS}) AS t FROM benchmark),
    rc AS (SELECT ref_id, t, count(*) AS n FROM r GROUP BY ALL), rs AS (SELECT ref_id, count(*) AS size FROM r GROUP BY ALL),
    d AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents), dc AS (SELECT doc_id, t, count(*) AS n FROM d GROUP BY ALL),
    s AS (SELECT ref_id, doc_id, sum(least(rc.n, dc.n)) / any_value(size) AS score FROM rc JOIN dc USING (t) JOIN rs USING (ref_id) GROUP BY ALL)
    SELECT ref_id, doc_id AS cand_id, round(score, 6) AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, doc_id) AS k FROM s) WHERE k = 1"""
)
def token_recall_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), T.label_text(F.col("text"), _PUNCT).alias("value"))
    cand = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cand_id"), T.label_text(F.col("text"), _PUNCT).alias("value"))
    return labelling.best_match(ref, cand).select("ref_id", "cand_id", _r("score").alias("score"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as benchmark items; the kind goes by id."""
    kind = F.element_at(F.array(F.lit("text"), F.lit("image"), F.lit("table")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), "url", kind.alias("kind"))


_TITLE = "replace(replace(url_decode(url), 'https://', ''), ' ', '_')"
_SUPPORT = "(SELECT doc_id::VARCHAR AS id FROM documents)"


@query(f"SELECT DISTINCT {_TITLE} AS title FROM pages WHERE url <> '' AND page_id::VARCHAR IN {_SUPPORT}")
def title_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    supporting = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    return labelling.clean_titles(_items(spark, sf_dir), supporting, "https://")


@query(
    f"""WITH i AS (SELECT page_id::VARCHAR AS id, {_TITLE} AS title, page_id % 3 AS k FROM pages WHERE url <> '')
    SELECT title, coalesce(list(id ORDER BY id) FILTER (WHERE k = 0), []) AS text, coalesce(list(id ORDER BY id) FILTER (WHERE k = 1), []) AS image,
           coalesce(list(id ORDER BY id) FILTER (WHERE k = 2), []) AS "table" FROM i GROUP BY title"""
)
def title_component_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    titles = items.where("url <> ''").select(T.wiki_title(F.col("url"), "https://").alias("title")).distinct()
    return labelling.title_components(items, titles, "https://")


@query(
    """WITH m AS (SELECT l.doc_id AS component_id, CASE WHEN toxic = 1 THEN 'table' WHEN quality = 1 THEN 'text' ELSE 'image' END AS kind, l.doc_id::VARCHAR AS ref_id FROM labels l),
    u AS (SELECT component_id, list(ref_id ORDER BY CASE kind WHEN 'text' THEN 1 WHEN 'table' THEN 2 ELSE 3 END, ref_id) AS uuids FROM m GROUP BY ALL)
    SELECT doc_id AS component_id, coalesce(uuids, []) AS uuids FROM documents LEFT JOIN u ON component_id = doc_id"""
)
def label_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "table").when(F.col("quality") == 1, "text").otherwise("image")
    matches = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("component_id"), kind.alias("kind"), F.col("doc_id").cast("string").alias("ref_id"))
    return labelling.label_components(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("component_id")), matches)


# ---------------------------------------------------------------- text functions

_FILE = "url_decode(list_last(string_split(split_part(url, '?', 1), '/')))"
_STEM = rf"regexp_replace({_FILE}, '(?s)^(\.*[^.].*)\.[^.]*$', '\1')"
_CLEAN = r"rtrim(regexp_replace({}, '[^\p{{L}}\p{{N}} _-]', '', 'g'))"


@query(
    f"""SELECT page_id, {_CLEAN.format('url')} AS clean, {_CLEAN.format(_STEM)} AS name,
    lower(regexp_extract({_FILE}, '(?s)^\\.*[^.].*\\.([^.]*)$', 1)) AS extension, 'out/' || {_CLEAN.format(_STEM)} || '.png' AS path FROM pages"""
)
def url_clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        T.clean_name(url).alias("clean"),
        T.url_name(url).alias("name"),
        T.url_extension(url).alias("extension"),
        T.save_path(F.lit("out"), T.url_name(url), F.lit("png")).alias("path"),
    )


@query(
    """WITH d AS (SELECT doc_id, source, lang, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS p, text FROM documents),
    e AS (SELECT doc_id, source, lang, CASE WHEN len(p) > 0 THEN p WHEN text <> '' THEN [text] ELSE [' '] END AS p FROM d)
    SELECT doc_id, unnest(range(len(p))) AS sub_idx, source || ' [SEP] ' || lang || ' [SEP] ' || unnest(p) AS text FROM e"""
)
def paragraph_subcomponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = T.component_prefix(F.col("source"), F.array("lang"))
    parts = table(spark, sf_dir, "documents").select("doc_id", prefix.alias("p"), F.posexplode(T.paragraphs(F.col("text"))).alias("i", "s"))
    return parts.select("doc_id", F.col("i").cast("long").alias("sub_idx"), T.remove_newlines(F.concat("p", "s")).alias("text"))


def _part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per brand: a header, then its parts in order; the name cell holds an image link."""
    link = F.concat(F.lit("[[http://x/"), F.col("p_partkey").cast("string"), F.lit(".png]] "), F.col("p_name"))
    row = F.struct("p_partkey", F.array(link, F.col("p_type"), F.col("p_size").cast("string")).alias("r"))
    head = F.array(F.array(F.lit("Name"), F.lit("Type"), F.lit("Size")))
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("p_brand", F.concat(head, F.col("rows.r")).alias("table"))


@query(
    """WITH r AS (SELECT p_brand, p_partkey, p_name, p_type, p_size FROM part)
    SELECT p_brand, 'Name Type Size [SEP] ' || string_agg(trim(p_name) || ' ' || p_type || ' ' || p_size, ' [SEP] ' ORDER BY p_partkey) AS flat,
           'Name Type Size ' || string_agg(trim(p_name) || ' ' || p_type || ' ' || p_size, ' ' ORDER BY p_partkey) AS serial,
           CASE WHEN count(*) <= 1 THEN 1 ELSE count(*) END AS n_subs FROM r GROUP BY p_brand"""
)
def table_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.col("table")
    return _part_tables(spark, sf_dir).select(
        "p_brand", T.flatten_table(cells).alias("flat"), T.table_for_labels(cells).alias("serial"), F.size(T.table_subcomponents(cells)).cast("long").alias("n_subs")
    )


@query("SELECT p_brand, list('http://x/' || p_partkey || '.png' ORDER BY p_partkey) AS links FROM part GROUP BY p_brand")
def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.flatten("table")
    return _part_tables(spark, sf_dir).select("p_brand", F.flatten(F.transform(cells, T.links)).alias("links"))


_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_ANSWERS = rf"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(lower(text), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '{_WORD}+|{_WORD.replace("[", "[^", 1)}+') AS parts, text FROM conversations)
    SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN trim(regexp_replace(array_to_string(list_transform(parts, lambda w: CASE WHEN w IN ('a', 'an', 'the') THEN ' ' ELSE w END), ''), '[\t-\r\x{{85}}\p{{Z}}]+', ' ', 'g')) END AS answer FROM t"""


@query(_ANSWERS)
def normalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_answer(F.col("text")).alias("answer"))


@query(_ANSWERS)
def normalized_answers_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized_answers(spark, sf_dir)


# ---------------------------------------------------------------- evaluation

_ANSWER = "CASE WHEN quality = 1 THEN 'x f_answers([\"good\", ''doc ' || toxic || ''']) y' ELSE ' Plain ' END"


@query(
    """WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN ['doc ' || toxic, 'good'] ELSE ['plain'] END AS p,
      CASE WHEN doc_id % 3 = 0 THEN ['doc 0', 'good'] WHEN doc_id % 3 = 1 THEN ['good'] ELSE ['plain'] END AS t FROM labels)
    SELECT count(*) AS n, round(100 * avg((list_sort(p) = list_sort(t))::INT), 6) AS em, round(100 * avg(2.0 * len(list_intersect(p, t)) / (len(p) + len(t))), 6) AS f1 FROM a"""
)
def eval_em_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    call = F.concat(F.lit("x f_answers([\"The good!\", 'Doc "), F.col("toxic").cast("string"), F.lit("']) y"))
    answers = rows.select(F.col("doc_id").alias("qid"), F.when(F.col("quality") == 1, call).otherwise(" Plain ").alias("answer"))
    truth = rows.select(
        F.col("doc_id").alias("qid"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("doc 0"), F.lit("good"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("A good"))).otherwise(F.array(F.lit("plain"))).alias("answers"),
    )
    return evaluation.em_f1(answers, truth).select("n", _r("em").alias("em"), _r("f1").alias("f1"))


@query(
    """WITH j AS (SELECT conv_id, list(DISTINCT role) FILTER (WHERE turn % 2 = 0) AS gold, list(DISTINCT role) AS found FROM conversations GROUP BY conv_id)
    SELECT count(*) AS n, count_if(coalesce(list_has_any(gold, found), false)) AS exists_n, avg(coalesce(list_has_any(gold, found), false)::INT) AS exists_rate,
           count_if(coalesce(list_has_all(found, gold), true)) AS perfect_n, avg(coalesce(list_has_all(found, gold), true)::INT) AS perfect_rate FROM j"""
)
def eval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.collect_set(F.when(F.col("turn") % 2 == 0, F.col("role"))).alias("gold"), F.collect_set("role").alias("found")
    )
    return evaluation.match_rates(lists)


@query("SELECT count(*) AS total, count_if(l.doc_id IS NOT NULL) AS success, count_if(l.doc_id IS NULL) AS failed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_l", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labelled, "doc_id", "left")
    return evaluation.batch_summary(rows.withColumn("error", F.when(F.col("_l").isNull(), "no label")))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return still_to_do(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    """SELECT d.doc_id::VARCHAR AS image, d.lang AS explanation, d.source AS ocr, CASE WHEN l.doc_id IS NULL THEN [] ELSE [[0, 0, quality, toxic]] END AS bboxes
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def image_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("image"), F.col("lang").alias("explanation"), F.col("source").alias("ocr"))
    boxes = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("image"), F.array(F.array(F.lit(0), F.lit(0), "quality", "toxic")).alias("bboxes"))
    return image_metadata(described, boxes)


@query("SELECT label, count(*) AS n, count(DISTINCT vec_id) AS distinct_n, min(len(embedding)) AS dim FROM embeddings GROUP BY label")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.count("*").alias("n"), F.countDistinct("vec_id").alias("distinct_n"), F.min(F.size("embedding")).cast("long").alias("dim")
    )


# ---------------------------------------------------------------- prompts and pages


@query(
    """WITH b AS (SELECT conv_id, turn, '/*' || chr(10) || '[Passage]' || chr(10) || 'Title: ' || role || chr(10) || 'Section: turn, ' || turn || chr(10) || chr(10) || text || chr(10) || '*/' || chr(10) || chr(10) AS block FROM conversations)
    SELECT conv_id AS qid, 'Answer the question from the passages and tables below. Call f_answers([...]) with a short answer.' || chr(10) || chr(10) || chr(10)
    || string_agg(block, chr(10) ORDER BY turn, block) || chr(10) || 'Question = What is said in ' || conv_id || '?' || chr(10) || 'The answer is: ' AS prompt FROM b GROUP BY conv_id"""
)
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    blocks = turns.select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), prompts.passage_block(F.col("role"), F.array(F.lit("turn"), F.col("turn").cast("string")), F.col("text")).alias("block"), F.lit(False).alias("is_image"))
    asked = turns.select(F.col("conv_id").alias("qid")).distinct().withColumn("question", F.concat(F.lit("What is said in "), F.col("qid").cast("string"), F.lit("?")))
    return prompts.question_prompts(blocks, asked)


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 END AS image_no FROM conversations"""
)
def prompt_image_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), (F.col("role") == "user").alias("has_image"))
    return prompts.number_images(evidence).select(F.col("qid").alias("conv_id"), F.col("pos").alias("turn"), "image_no")


@query(
    """SELECT p_brand, '/*' || chr(10) || '[Table]' || chr(10) || 'Title: ' || p_brand || chr(10) || 'Section: parts, all' || chr(10) || chr(10) || 'Name | Type | Size' || chr(10)
    || string_agg(CASE WHEN k = 1 THEN '<Image 7> , ' ELSE '' END || trim(p_name) || ' | ' || p_type || ' | ' || p_size || chr(10), '' ORDER BY p_partkey) || '*/' || chr(10) || chr(10) AS block
    FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN row_number() OVER (PARTITION BY p_brand, p_partkey % 3 = 0 ORDER BY p_partkey) END AS k FROM part) GROUP BY p_brand"""
)
def prompt_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as blocks; the images of every third part exist."""
    tables = _part_tables(spark, sf_dir)
    there = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.collect_list(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"), F.lit(".png")))).alias("there")
    )
    found = tables.join(there, "p_brand").withColumn("first", prompts.first_table_image(F.col("table"), F.col("there")))
    number = F.when(F.col("first").isNotNull(), F.lit(7))
    return found.select("p_brand", prompts.table_block(F.col("p_brand"), F.array(F.lit("parts"), F.lit("all")), F.col("table"), F.col("first"), number).alias("block"))


@query(
    """SELECT doc_id, '/*' || chr(10) || '[Image]' || chr(10) || 'Title: ' || source || chr(10) || 'Section: ' || lang || chr(10) || chr(10)
    || CASE WHEN doc_id % 2 = 0 THEN '<Image ' || doc_id || '>' || chr(10) || 'Caption: ' || coalesce(text, '') || chr(10) ELSE '' END || '*/' || chr(10) || chr(10) AS block FROM documents"""
)
def prompt_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as image captions; the images of even ids exist."""
    number = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))
    block = prompts.image_block(F.col("source"), F.array("lang"), F.col("text"), number)
    return table(spark, sf_dir, "documents").select("doc_id", block.alias("block"))


@query(
    """SELECT doc_id, lang || ' [SEP] ' || source || ' [SEP] ' || coalesce(source, '') || CASE WHEN doc_id % 2 = 0 THEN ' [SEP] ' || lang ELSE '' END AS text FROM documents"""
)
def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image components as text; those of even ids have an explanation, none has OCR text."""
    prefix = T.component_prefix(F.col("lang"), F.array("source"))
    explained = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", T.image_text(prefix, F.col("source"), explained, F.lit("")).alias("text"))


@query("SELECT page_id, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"'']', 1) AS h FROM pages)")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_links(table(spark, sf_dir, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query()
def html_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_components(table(spark, sf_dir, "pages"))


_ELEMENT = "{{'section': {0}section, 'level': {0}level, 'title': {0}title, 'path': []::VARCHAR[], 'closed': -1::BIGINT, 'closing': {0}closing}}"
_FOLD = """list_reduce(es, lambda a, e: {'section': e.section, 'level': 0::BIGINT, 'title': '',
      'path': CASE WHEN e.level >= 2 AND a.closed <> e.section AND NOT e.closing THEN list_concat(list_slice(a.path, 1, e.level - 2), [e.title]) ELSE a.path END,
      'closed': CASE WHEN e.level >= 2 AND a.closed <> e.section AND e.closing THEN e.section ELSE a.closed END, 'closing': false})"""


@query(
    f"""WITH t AS (SELECT conv_id, (turn // 4)::BIGINT AS section, (CASE WHEN role = 'user' THEN 2 + len(text) % 4 ELSE 0 END)::BIGINT AS level,
      CASE WHEN role = 'user' AND len(text) % 7 = 0 THEN 'See also ' ELSE '' END || split_part(text, ' ', 1) AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
    e AS (SELECT *, regexp_matches(lower(title), 'references|see also|external links|notes|further reading|sources') AS closing FROM t),
    p AS (SELECT x.conv_id, x.pos, x.section, list({_ELEMENT.format('y.')} ORDER BY y.pos) FILTER (WHERE y.pos < x.pos) AS es0
      FROM e x JOIN e y ON x.conv_id = y.conv_id AND y.pos <= x.pos WHERE x.level = 0 GROUP BY ALL),
    q AS (SELECT conv_id, pos, section, list_concat([{{'section': -1::BIGINT, 'level': 0::BIGINT, 'title': '', 'path': []::VARCHAR[], 'closed': -1::BIGINT, 'closing': false}}], coalesce(es0, [])) AS es FROM p),
    f AS (SELECT conv_id, pos, section, {_FOLD} AS r FROM q)
    SELECT conv_id, pos AS "at", r.path AS heading_path FROM f WHERE r.closed <> section"""
)
def conversation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of heading paths and closing headings, over conversations: four turns are a section, a user's turn is a heading."""
    turns = table(spark, sf_dir, "conversations")
    user, title, odd = F.col("role") == "user", F.split_part("text", F.lit(" "), F.lit(1)), F.length("text") % 7 == 0
    e = F.struct(
        F.col("turn").alias("turn"),
        F.floor(F.col("turn") / 4).cast("int").alias("section"),
        F.when(user, (2 + F.length("text") % 4)).cast("int").alias("level"),
        F.when(user & odd, F.concat(F.lit("See also "), title)).otherwise(title).alias("title"),
    )
    pages = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(e)).alias("e"))
    return pages.select("conv_id", F.inline(html.heading_paths(F.col("e")))).select("conv_id", F.col("at").cast("long").alias("at"), "heading_path")


@query()
def question_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-queries, modalities and vectors of all user turns, with the offline stand-ins."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = turns.select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.col("text").alias("question"))
    return models.plan_questions(asked, models.RuleGenerator(), models.HashEmbedder(16))


@query()
def component_graph_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to numbered components to edges: the index build on crawled markup."""
    made = html.page_components(table(spark, sf_dir, "pages")).where("error is null")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("idx")) - 1
    comps = made.select((F.shiftleft("page_id", 32) + rank).alias("component_id"), F.col("page_id").cast("string").alias("doc_title"), F.col("edge").alias("neighbor_titles"))
    return graph.build_edges(comps)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: multi-hop retrieval of all questions over the component graph."""
    return multi_hop_topk(tuned(spark), sf_dir)
