"""Queries of the document operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.functions import chunks as chunk_fns
from lekhya.functions import text as text_fns
from lekhya.functions.vectors import cosine, dot
from lekhya.io import table
from lekhya.operators import entities, hierarchy, metadata, metrics, ocr, relevance, retrieval, store, training
from lekhya.rules import NEPALI

Query = Callable[[SparkSession, str], DataFrame]
#: White space of Unicode, for RE2.
WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
D = "[0-9०-९]"
K = 10
#: Queries of the searches: every row whose id this divides, against all rows.
EVERY = 50


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, name)


_chunks, _entities, _outputs, _documents, _embeddings, _acts = (_t(n) for n in ("chunks", "entities", "ner_outputs", "documents", "embeddings", "acts"))


# --- text ------------------------------------------------------------------


def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document cleaned as a page."""
    return _documents(spark, d).select("doc_id", text_fns.clean(F.col("text")).alias("cleaned"))


def act_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Keys made of file names and years."""
    a = _acts(spark, d)
    name = F.concat(F.lit("in/"), F.col("act_slug"), F.lit(" Copy.PDF"))
    return a.select("act_id", text_fns.slug(name).alias("slug"), text_fns.slug_prefix(F.col("act_slug"), F.col("bs_year")).alias("prefix"))


def digits_to_int(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in either script to integers."""
    a = _acts(spark, d)
    return a.select("act_id", F.coalesce(text_fns.to_int(F.col("title")), F.lit(-1)).alias("in_title"), F.coalesce(text_fns.to_int(F.col("date_published"), "bigint"), F.lit(-1)).alias("in_date"))


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Characters, words and estimated tokens of every chunk."""
    c, t = _chunks(spark, d), F.col("text")
    return c.filter("text IS NOT NULL").select(
        "chunk_row_id", F.length(t).alias("characters"), text_fns.word_count(t).alias("n_words"), text_fns.token_estimate(t).alias("tokens")
    )


def chunk_references(spark: SparkSession, d: str) -> DataFrame:
    """References found again in the texts of the chunks, as edges."""
    refs = hierarchy.extract_references(F.col("text"), text_fns.slug_prefix(F.col("act_slug"), F.lit(None).cast("int")))
    rows = _chunks(spark, d).select("chunk_row_id", F.posexplode(refs).alias("ref_pos", "r"))
    return rows.select("chunk_row_id", "ref_pos", F.col("r.type").alias("ref_type"), F.col("r.id").alias("ref_id"), F.col("r.text").alias("ref_text"))


def parse_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents parsed as acts into chunks."""
    docs = _documents(spark, d).select(F.col("doc_id").cast("string").alias("doc"), F.coalesce("act_slug", F.lit("")).alias("slug"), F.lit(None).cast("int").alias("bs_year"), "text")
    got = hierarchy.parse(docs)
    return got.select("doc", "ord", "id", "type", F.coalesce("hierarchy.sec", F.lit(-1)).alias("sec"), F.col("hierarchy.clause").alias("clause"), "text", F.col("stats.tokens").alias("tokens"))


def parsed_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Titles, levels, provisos and explanations of the chunks of documents."""
    docs = _documents(spark, d).select(F.col("doc_id").cast("string").alias("doc"), F.coalesce("act_slug", F.lit("")).alias("slug"), F.lit(2080).alias("bs_year"), "text")
    h = hierarchy.parse(docs)
    return h.select(
        "doc", "ord", F.coalesce("hierarchy.ch", F.lit(-1)).alias("ch"), F.col("hierarchy.ch_title").alias("ch_title"), F.col("hierarchy.sec_title").alias("sec_title"),
        F.coalesce("hierarchy.sub", F.lit(-1)).alias("sub"), F.get("provisos", F.lit(0)).alias("proviso"), F.get("explanations", F.lit(0)).alias("explanation"), F.regexp_extract("id", r"-(\d{4}|None)(?:-|$)", 1).alias("year"),
    )


def amendment_entries(spark: SparkSession, d: str) -> DataFrame:
    """The amendments of every act, written as its front page and read again."""
    a = _acts(spark, d)
    entry = F.transform("amended_refs", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(r["ref"], F.lit("")), F.lit("  "), F.coalesce(r["date"], F.lit(""))))
    page = F.concat_ws("\n", "title", F.lit(NEPALI.amendment + ":"), F.array_join(entry, "\n"), F.lit("परिच्छेद १"), F.lit("9. after"))
    got = metadata.extract(a.select("act_id", page.alias("page")), "page")
    rows = got.select("act_id", F.posexplode("act_metadata.amended_refs").alias("pos", "r"))
    return rows.select("act_id", "pos", F.col("r.ref").alias("ref"), F.col("r.date").alias("date"))


def document_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks per document of the parser, before they become chunks."""
    docs = _documents(spark, d).filter("text IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    return hierarchy.content(hierarchy.lines_of(docs)).groupBy("doc").agg(F.count("*").alias("n_lines"), F.min("pos").alias("first_pos"))


def front_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Title, type, year and dates of every document's front lines."""
    got = metadata.extract(_documents(spark, d).select("doc_id", "text"))
    m = "act_metadata."
    return got.select("doc_id", *[F.col(m + c).alias(c) for c in ("bs_year", "type", "date_published", "date_commenced")], F.col(m + "title").alias("act_title"))


# --- relevance -------------------------------------------------------------


def keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    return relevance.scored(_chunks(spark, d)).select("chunk_row_id", "ner_score")


def relevant_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that pass the filter with their matched keywords, as rows."""
    got = relevance.relevant(_chunks(spark, d)).select("chunk_row_id", "ner_score", F.explode("ner_matched_groups").alias("keyword_group", "keywords"))
    return got.select("chunk_row_id", "ner_score", "keyword_group", F.explode("keywords").alias("keyword"))


def keyword_histogram(spark: SparkSession, d: str) -> DataFrame:
    return relevance.histogram(_chunks(spark, d))


def filter_stats(spark: SparkSession, d: str) -> DataFrame:
    return relevance.statistics(_chunks(spark, d))


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of three neighbouring relevant chunks of a section."""
    got = relevance.context_windows(relevance.scored(_chunks(spark, d)).filter("ner_score >= 2"), 3, "act_slug", "chunk_row_id")
    return got.select("act_slug", "chunk_row_id", F.length("text").alias("n_chars"), F.coalesce(F.size("merged_ids"), F.lit(1)).alias("n_merged"))


# --- composed texts --------------------------------------------------------


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return c.select("chunk_row_id", chunk_fns.embedding_text(F.col("hierarchy"), F.col("text"), F.col("provisos"), F.col("explanations")).alias("embedding_text"))


def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_row_id", chunk_fns.breadcrumb(F.col("hierarchy")).alias("path"), chunk_fns.preview(F.col("text"), 40).alias("preview"))


def clause_refs(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_row_id", chunk_fns.clause_ref(F.col("hierarchy"), F.col("type")).alias("clause_ref"))


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_row_id", chunk_fns.point_id(F.col("id")).alias("point_id"))


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The collection after all loads: the last row of every id."""
    return store.upserted(None, _chunks(spark, d).select("id", "chunk_row_id", F.coalesce(F.length("text"), F.lit(-1)).alias("n_chars")), "id", "chunk_row_id")


def upsert_twice(spark: SparkSession, d: str) -> DataFrame:
    """A first load of the odd rows, then an upsert of the even ones."""
    c = _chunks(spark, d).select("id", "chunk_row_id")
    return store.upserted(store.last_wins(c.filter("chunk_row_id % 2 = 1"), "id", "chunk_row_id"), c.filter("chunk_row_id % 2 = 0"), "id", "chunk_row_id")


def collection_info(spark: SparkSession, d: str) -> DataFrame:
    """Points per act of the collection."""
    return _chunks(spark, d).groupBy("act_slug").agg(F.count_distinct("id").alias("n_points"), F.count("*").alias("n_rows"))


# --- retrieval -------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _embeddings(spark, d)
    return e.select(F.col("vec_id").alias("docid"), F.col("embedding").alias("vector"), "label"), e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents, whose words count as weights, and word counts of the queries as maps."""
    docs = _documents(spark, d).select(F.col("doc_id").alias("docid"), "text")
    asked = retrieval.bags(docs.filter(F.col("docid") % EVERY == 0))  # filters don't pass the counting
    return docs, asked.select(F.col("docid").alias("qid"), F.col("weights").alias("qweights"))


def _bags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Word counts of the documents as maps, and those of the queries."""
    docs, asked = _texts(spark, d)
    return retrieval.bags(docs).select("docid", "weights"), asked


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, texts, queries with either)."""
    (corpus, dense), (texts, sparse) = _vectors(spark, d), _texts(spark, d)
    return corpus, texts, dense.join(sparse, "qid", "full")


def _rounded(df: DataFrame, col: str = "score") -> DataFrame:
    return df.withColumn(col, F.round(col, 6))


def _dense(similarity: Callable[[Column, Column], Column], **more: object) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        corpus, queries = _vectors(spark, d)
        where = F.col("label") == more["label"] if "label" in more else None
        return retrieval.dense_search(corpus, queries, K, similarity, where, more.get("threshold"), 6).select("qid", "docid", "score", "rank")

    return run


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.sparse_search(*_texts(spark, d), K).select("qid", "docid", "score", "rank")


def sparse_zeros_topk(spark: SparkSession, d: str) -> DataFrame:
    """The sparse ranking of all documents, those without a shared word last."""
    corpus, queries = _bags(spark, d)
    some = corpus.withColumn("weights", F.map_filter("weights", lambda k, _: F.length(k) > 9))
    asked = queries.withColumn("qweights", F.map_filter("qweights", lambda k, _: F.length(k) > 9)).filter(F.size("qweights") > 0)
    return retrieval.sparse_search(some, asked, K, zeros=True).select("qid", "docid", "score", "rank")


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of the dense and sparse top 2k of the same query ids."""
    return retrieval.hybrid_search(*_both(spark, d), K, digits=6).select("qid", "docid", "score", "rank")


def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    """1.0 * dense + 0.3 * sparse over all pairs, 0 where no word is shared."""
    corpus, texts, queries = _both(spark, d)
    full = corpus.join(retrieval.bags(texts).select("docid", "weights"), "docid", "left")
    return retrieval.weighted_search(full, queries, K, digits=6).select("qid", "docid", "score", "rank")


def two_stage(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search of 4k candidates, ranked again by shared words."""
    corpus, texts, queries = _both(spark, d)
    asked = queries.join(texts.filter(F.col("docid") % EVERY == 0).select(F.col("docid").alias("qid"), F.col("text").alias("query")), "qid")
    got = retrieval.two_stage("hybrid", corpus, texts, asked, texts, K, retrieval.overlap_scorer, digits=6)
    return got.select("qid", "docid", F.round("rerank_score", 6).alias("rerank_score"), "original_score", "rank")


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """The sparse top 4k ranked again by shared words."""
    docs, queries = _texts(spark, d)
    pool = retrieval.sparse_search(docs, queries, retrieval.RERANK_POOL * K)
    asked = docs.filter(F.col("docid") % EVERY == 0).select(F.col("docid").alias("qid"), F.col("text").alias("query"))
    got = retrieval.second_stage(pool, asked, docs, K)
    return got.select("qid", "docid", F.round("rerank_score", 6).alias("rerank_score"), "original_score", "rank")


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the dense runs, a vector of the same label being relevant.

    The judgements are counted by label; their pairs are never made.
    """
    corpus, queries = _vectors(spark, d)
    label = corpus.select("docid", "label")
    asked = queries.join(label.withColumnRenamed("docid", "qid"), "qid").select("qid", F.col("label").alias("_asked"))
    most = max(metrics.K_VALUES)
    runs = [retrieval.dense_search(corpus, queries, most, f, digits=6).withColumn("method", F.lit(n)) for n, f in (("cosine", cosine), ("dot", dot))]
    run = runs[0].unionByName(runs[1]).join(label, "docid").join(asked, "qid")
    judged = run.withColumn("rel", (F.col("label") == F.col("_asked")).cast("int")).drop("label", "_asked")
    gains = asked.join(label.groupBy(F.col("label").alias("_asked")).agg(F.count("*").alias("n")), "_asked").select("qid", F.lit(1).alias("rel"), "n")
    report = metrics.means(metrics.of_judged(judged, gains))
    return report.select("method", "K", *[F.round(m, 4).alias(m) for m in metrics.METRICS])


def gold_matched(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose chunk is in the corpus, numbered in order."""
    gold = _entities(spark, d).select(F.col("entity_id").alias("ord"), F.col("chunk_id").alias("docid"))
    return metrics.matched_gold(gold, _chunks(spark, d).select(F.col("id").alias("docid")))


def gold_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose chunk is not in the corpus."""
    gold = _entities(spark, d).select(F.col("entity_id").alias("ord"), F.col("chunk_id").alias("docid"))
    return metrics.skipped_gold(gold, _chunks(spark, d).select(F.col("id").alias("docid")))


def corpus_last_text(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by id: the last text at the first place."""
    c = _chunks(spark, d).select(F.col("id").alias("docid"), F.coalesce("text", F.lit("")).alias("text"), F.col("chunk_row_id").alias("ord"))
    return metrics.last_text(c)


# --- entities --------------------------------------------------------------


def cleaned_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Every output with its fields cleaned."""
    o = _outputs(spark, d)
    return o.select(
        "output_id", entities.clean_office(F.col("office")).alias("office"), entities.clean_price(F.col("price")).alias("price"),
        entities.clean_duration(F.col("duration_days")).alias("duration"), entities.clean_prerequisites(F.col("prerequisites")).alias("prerequisites"),
        F.size(entities.clean_documents(F.col("documents_required"))).alias("n_documents"), F.size(entities.clean_steps(F.col("steps"))).alias("n_steps"),
    )


def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Outputs written as JSON answers in a fence and parsed again."""
    fields = ("office", "documents_required", "steps", "price", "duration_days", "prerequisites")
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.lit("\n```"))
    got = _outputs(spark, d).withColumn("_v", F.try_parse_json(entities.unfenced(answer))).withColumn("_a", entities.parse_variant(F.col("_v")))
    return got.select(
        "output_id", F.col("_a.office").alias("office"), F.col("_a.price").alias("price"), F.coalesce(F.size("_a.documents_required"), F.lit(0)).alias("n_documents"),
        F.coalesce(F.size("_a.steps"), F.lit(0)).alias("n_steps"),
    )


def parsed_fees(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in the price texts of the outputs."""
    rows = _outputs(spark, d).select("output_id", F.posexplode(entities.parse_fees(F.col("price"))).alias("fee_pos", "f"))
    return rows.select("output_id", "fee_pos", F.col("f.amount_raw").alias("amount_raw"), F.coalesce("f.amount_npr", F.lit(-1)).alias("amount_npr"))


def office_levels(spark: SparkSession, d: str) -> DataFrame:
    """Offices of the outputs with their level of government."""
    got = _outputs(spark, d).select("output_id", entities.parse_office(F.col("office")).alias("o"))
    return got.filter("o IS NOT NULL").select("output_id", F.col("o.name").alias("name"), F.col("o.level").alias("level"))


def task_names(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).select("entity_id", entities.task_name(F.col("clause_ref"), F.col("steps"), F.col("documents_required")).alias("task_name"))


def _workflows(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d).withColumn("ord", F.col("entity_id"))
    return entities.workflows(e)


def workflows(spark: SparkSession, d: str) -> DataFrame:
    """Workflows of acts and tasks: descriptions and sizes of their lists."""
    names = ("offices", "all_documents", "all_steps", "all_fees", "durations", "prerequisites")
    return _workflows(spark, d).select("act_slug", "task_name", "description", "n_entities", *[F.coalesce(F.size(n), F.lit(0)).cast("bigint").alias("n_" + n) for n in names])


def workflow_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every workflow in their order."""
    return _workflows(spark, d).select("act_slug", "task_name", F.posexplode("all_documents").alias("pos", "document"))


def workflow_sources(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d).withColumn("ord", F.col("entity_id"))
    return entities.source_clauses(e)


def distinct_documents(spark: SparkSession, d: str) -> DataFrame:
    """The required documents of every entity, each once, in order."""
    e = _entities(spark, d).select("entity_id", F.posexplode(entities.distinct_texts(F.col("documents_required"))).alias("pos", "document"))
    return e


def entity_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Entities joined to the rows of their chunk id."""
    c = _chunks(spark, d).select(F.col("id").alias("chunk_id"), "chunk_row_id", F.col("type").alias("chunk_type"))
    return _entities(spark, d).select("entity_id", "chunk_id").join(c, "chunk_id")


def otsu_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds of histograms: quantities as levels, one image per supplier."""
    pixels = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_quantity").cast("int").alias("level"))
    return ocr.otsu(ocr.histogram(pixels))


def title_queries(spark: SparkSession, d: str) -> DataFrame:
    return training.title_queries(_chunks(spark, d))


def reference_queries(spark: SparkSession, d: str) -> DataFrame:
    return training.reference_queries(_chunks(spark, d))


def definition_queries(spark: SparkSession, d: str) -> DataFrame:
    """Questions about the section titles, written as defined terms before the texts."""
    c = _chunks(spark, d).filter("hierarchy.sec_title IS NOT NULL")
    term = F.concat(F.lit('“'), F.regexp_replace("hierarchy.sec_title", '["”]', ""), F.lit('” भन्नाले '), F.coalesce("text", F.lit("")))
    return training.definition_queries(c.withColumn("text", term))


def negative_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per chunk its negatives that are what they must be: hard of the same chapter and another section, others of another chapter or act."""
    c = _chunks(spark, d)
    key = c.select("chunk_row_id", F.struct(F.coalesce("act_slug", F.lit("")).alias("act"), F.coalesce("hierarchy.ch", F.lit(-1)).alias("ch")).alias("part"), F.coalesce("hierarchy.sec", F.lit(-1)).alias("sec"))
    other = key.select(F.col("chunk_row_id").alias("negative_id"), F.col("part").alias("_part"), F.col("sec").alias("_sec"))
    got = training.negatives(c).distinct().join(key, "chunk_row_id").join(other, "negative_id")
    hard = F.col("hard") & (F.col("part") == F.col("_part")) & (F.col("sec") != F.col("_sec"))
    return got.groupBy("chunk_row_id").agg(F.sum(hard.cast("int")).alias("n_hard"), F.sum((~F.col("hard") & (F.col("part") != F.col("_part"))).cast("int")).alias("n_other"))


def triple_texts(spark: SparkSession, d: str) -> DataFrame:
    """Queries and positives of the training triples."""
    got = training.triples(_chunks(spark, d))
    return got.select("query", F.col("pos")[0].alias("positive"), F.col("meta.chunk_id").alias("chunk_id"))


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return training.negatives(_chunks(spark, d))


def training_triples(spark: SparkSession, d: str) -> DataFrame:
    got = training.triples(_chunks(spark, d))
    return got.select("query", F.col("pos")[0].alias("positive"), F.size("neg").alias("n_negatives"), F.col("meta.chunk_id").alias("chunk_id"), "split")


def queries() -> dict[str, Query]:
    own = (
        clean_documents, act_slugs, digits_to_int, chunk_stats, chunk_references, parse_documents, parsed_hierarchy, amendment_entries, document_blocks, front_metadata, keyword_scores,
        relevant_chunks, keyword_histogram, filter_stats, context_windows, embedding_texts, breadcrumbs, clause_refs, point_ids, upsert_last_wins,
        upsert_twice, collection_info, sparse_topk, sparse_zeros_topk, hybrid_rrf, hybrid_weighted, two_stage, reranked, eval_metrics, gold_matched, gold_skipped, corpus_last_text,
        cleaned_outputs, parsed_answers, parsed_fees, office_levels, task_names, workflows, workflow_documents, workflow_sources, distinct_documents,
        entity_chunks, otsu_thresholds, title_queries, reference_queries, definition_queries, negative_counts, triple_texts, hard_negatives, training_triples,
    )
    return {
        "dense_cosine_topk": _dense(cosine), "dense_dot_topk": _dense(dot), "dense_filtered_topk": _dense(cosine, label=1),
        "dense_threshold": _dense(cosine, threshold=0.2), **{f.__name__: f for f in own},
    }


# --- SQL -------------------------------------------------------------------


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _words(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> ''))"


def _any(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _score() -> str:
    groups = " + ".join(f"CAST({_any('text', ws)} AS INT)" for ws in NEPALI.keyword_groups.values())
    skip = _any("coalesce(hierarchy.sec_title, '')", NEPALI.skip_titles)
    types = ", ".join(f"'{t}'" for t in NEPALI.skip_types)
    return f"CASE WHEN length(coalesce(text, '')) >= {NEPALI.min_length} AND NOT {skip} AND coalesce(type NOT IN ({types}), true) THEN {groups} ELSE 0 END"


def _to_int(x: str, kind: str = "INTEGER") -> str:
    return f"try_cast(nullif(translate(regexp_replace({x}, '[^0-9०-९]', '', 'g'), '०१२३४५६७८९', '0123456789'), '') AS {kind})"


def _topk(scores: str) -> str:
    return f"SELECT qid, docid, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM ({scores})) WHERE rank <= {K}"


def _dense_sql(fn: str, where: str = "true") -> str:
    return (
        f"SELECT q.vec_id AS qid, c.vec_id AS docid, round({fn}(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score "
        f"FROM embeddings q, embeddings c WHERE q.vec_id % {EVERY} = 0 AND {where}"
    )


_BAGS = f"""bags AS (SELECT docid, token, CAST(count(*) AS DOUBLE) AS w FROM (SELECT doc_id AS docid, unnest(string_split(text, ' ')) AS token FROM documents WHERE text IS NOT NULL) WHERE token <> '' GROUP BY ALL),
sparse AS (SELECT q.docid AS qid, c.docid, sum(q.w * c.w) AS score FROM bags q JOIN bags c USING (token) WHERE q.docid % {EVERY} = 0 GROUP BY ALL)"""


def _ranked(source: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM {source}) WHERE rank <= {k})"


def _second_stage(tables: str, pool: str) -> str:
    """The best 4k of ``pool`` by shared distinct words over the root of both numbers of words."""
    return f"""WITH {_BAGS}, {tables}
        pool AS {_ranked(pool, 4 * K)},
        sets AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '')) AS ws FROM documents),
        pairs AS (SELECT p.qid, p.docid, p.score AS original_score, p.rank AS old, CASE WHEN len(q.ws) > 0 AND len(d.ws) > 0
            THEN len(list_intersect(q.ws, d.ws)) / sqrt(CAST(len(q.ws) AS DOUBLE) * len(d.ws)) ELSE 0.0 END AS x
            FROM pool p JOIN sets d ON p.docid = d.doc_id JOIN sets q ON p.qid = q.doc_id)
        SELECT qid, docid, round(1 / (1 + exp(-x)), 6) AS rerank_score, original_score, rank FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY 1 / (1 + exp(-x)) DESC, old) AS INT) AS rank FROM pairs) WHERE rank <= {K}"""


_H = "hierarchy"
_PATH = "concat_ws(' › ', {0})"


def _short(title: str) -> str:
    cut = rf"regexp_replace(substring({title}, 1, 30), '{WS}+$', '') || CASE WHEN length({title}) > 30 THEN '...' ELSE '' END"
    return f"CASE WHEN coalesce({title}, '') <> '' THEN ' (' || {cut} || ')' ELSE '' END"


_CLAUSE_REF = f"""SELECT chunk_row_id, CASE WHEN p = '' THEN '(root)' ELSE p END || ' [' || coalesce(type, '') || ']' AS clause_ref FROM (
  SELECT chunk_row_id, type, concat_ws(' › ',
    CASE WHEN contains(coalesce(type, ''), 'anusuchi') THEN 'anusuchi' ELSE 'ch' END || hierarchy.ch || {_short("hierarchy.ch_title")},
    'sec' || hierarchy.sec || {_short("hierarchy.sec_title")}, 'sub' || hierarchy.sub, 'cl' || hierarchy.clause) AS p FROM chunks)"""

_TASK = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for p, n in NEPALI.task_rules) + f" ELSE '{NEPALI.default_task}' END"
_TASKS = f"""tasks AS (SELECT *, {_TASK} AS task_name FROM (SELECT *, concat_ws(' ', clause_ref, array_to_string(steps, ' '), array_to_string(documents_required, ' ')) AS t FROM entities))"""


def _distinct_list(column: str) -> str:
    """Rows (act_slug, task_name, item, at) of the distinct items of a list column."""
    return f"""SELECT act_slug, task_name, item, min(place) AS place FROM (
      SELECT act_slug, task_name, {_strip(f"{column}[i]")} AS item, struct_pack(o := entity_id, p := i) AS place FROM tasks, unnest(range(1, len({column}) + 1)) AS u(i))
      WHERE item IS NOT NULL AND item <> '' GROUP BY ALL"""


def _otsu() -> str:
    return """WITH h AS (SELECT l_suppkey AS image, CAST(l_quantity AS INT) AS level, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
    s AS (SELECT image, level, sum(n) OVER w AS wb, sum(level * n) OVER w AS sb, sum(n) OVER (PARTITION BY image) AS total, sum(level * n) OVER (PARTITION BY image) AS st
          FROM h WINDOW w AS (PARTITION BY image ORDER BY level)),
    v AS (SELECT image, level, CASE WHEN total - wb > 0 THEN wb * (total - wb) * (sb / wb - (st - sb) / (total - wb)) * (sb / wb - (st - sb) / (total - wb)) END AS var FROM s),
    b AS (SELECT image, level, row_number() OVER (PARTITION BY image ORDER BY var DESC, level) AS r FROM v WHERE var > 0)
    SELECT i.image, CAST(coalesce(b.level, 128) AS INT) AS threshold FROM (SELECT DISTINCT image FROM h) i LEFT JOIN b ON i.image = b.image AND b.r = 1"""


def _metric_sql() -> str:
    ks = ", ".join(f"({k})" for k in metrics.K_VALUES)
    return f"""WITH runs AS (SELECT 'cosine' AS method, * FROM ({_dense_sql("list_cosine_similarity")}) UNION ALL SELECT 'dot', * FROM ({_dense_sql("list_dot_product")})),
    rk AS (SELECT *, row_number() OVER (PARTITION BY method, qid ORDER BY score DESC, docid) AS rank FROM runs),
    lab AS (SELECT r.*, CAST(a.label = b.label AS INT) AS rel FROM rk r JOIN embeddings a ON r.docid = a.vec_id JOIN embeddings b ON r.qid = b.vec_id WHERE rank <= 10),
    cum AS (SELECT *, sum(rel) OVER (PARTITION BY method, qid ORDER BY rank) AS hits FROM lab),
    nrel AS (SELECT q.vec_id AS qid, count(*) AS n FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % {EVERY} = 0 GROUP BY ALL),
    idcg AS (SELECT qid, n, K, (SELECT sum(1 / log2(i + 1)) FROM unnest(range(1, least(n, K) + 1)) AS u(i)) AS ideal FROM nrel, (VALUES {ks}) AS k(K)),
    per AS (SELECT method, qid, K, coalesce(1.0 / min(CASE WHEN rel = 1 AND rank <= K THEN rank END), 0) AS MRR,
        sum(CASE WHEN rank <= K THEN rel / log2(rank + 1) ELSE 0 END) / any_value(ideal) AS NDCG, sum(CASE WHEN rank <= K THEN rel ELSE 0 END) / any_value(n) AS Recall,
        sum(CASE WHEN rank <= K THEN rel ELSE 0 END) / K AS Precision, sum(CASE WHEN rank <= K AND rel = 1 THEN hits / rank ELSE 0 END) / any_value(least(n, K)) AS MAP,
        CAST(max(CASE WHEN rank <= K THEN rel ELSE 0 END) AS DOUBLE) AS HitRate FROM cum JOIN idcg USING (qid) GROUP BY method, qid, K)
    SELECT method, K, round(round(avg(MRR), 6), 4) AS MRR, round(round(avg(NDCG), 6), 4) AS NDCG, round(round(avg(Recall), 6), 4) AS Recall,
      round(round(avg(Precision), 6), 4) AS Precision, round(round(avg(MAP), 6), 4) AS MAP, round(round(avg(HitRate), 6), 4) AS HitRate FROM per GROUP BY ALL"""


def _lines_sql() -> str:
    """The lines of documents from where their content begins: table ``body``."""
    r = NEPALI
    word = " OR ".join([f"starts_with(line, '{x}')" for x in r.starts] + [f"contains(line, '{x}')" for x in r.start_contains])
    gazette = ", ".join(f"'{x}'" for x in r.gazette_words)
    return rf"""l AS (SELECT doc_id, act_slug, pos, {_strip("raw")} AS line FROM (SELECT doc_id, act_slug, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM (
        SELECT doc_id, act_slug, string_split(text, E'\n') AS a FROM documents WHERE text IS NOT NULL))),
    m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, starts_with(line, '{r.amendment}') AS amends, ({word}) AS word,
        line IN ({gazette}) AND NOT ({word}) AS gaz, regexp_matches(line, '^{D}+\.|^\({D}+\)') AS numbered FROM l WHERE line <> ''),
    m2 AS (SELECT *, coalesce(max(CAST(amends AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM m),
    st AS (SELECT *, min(CASE WHEN NOT amends AND (word OR gaz OR (numbered AND seen = 0) OR n > {r.front_lines}) THEN pos END) OVER (PARTITION BY doc_id) AS start_pos FROM m2),
    body AS (SELECT doc_id, act_slug, pos, line, NOT (pos = start_pos AND gaz) AS free FROM st WHERE pos >= start_pos)"""


def _parse_sql(wanted: str) -> str:
    """The parser's islands in SQL, from lines to chunks: the columns ``wanted``."""
    r = NEPALI
    ws = lambda p: p.replace("\\s", WS)
    annex, chapter, section, sub, clause = (ws(p) for p in (r.annex, r.chapter, r.section, r.subsection, r.clause))
    w = "PARTITION BY doc_id ORDER BY pos"
    held = lambda value, flag, over: f"max(CASE WHEN {flag} THEN {value} END) OVER (PARTITION BY doc_id, {over})"
    isl = lambda flags: f"sum(CAST({flags} AS INT)) OVER ({w})"
    ex = lambda p, g: f"regexp_extract(line, '{p}', {g})"
    annex_no = f"CASE WHEN {ex(annex, 1)} = '' THEN 1 ELSE {_to_int(ex(annex, 1))} END"
    has = lambda c: f"CASE WHEN {c} IS NOT NULL THEN"
    return rf"""WITH {_lines_sql()},
    t1 AS (SELECT *, free AND regexp_matches(line, '{annex}') AS a FROM body),
    t2 AS (SELECT *, free AND NOT a AND regexp_matches(line, '{chapter}') AS c FROM t1),
    t3 AS (SELECT *, {isl("(a OR c)")} AS ch_island FROM t2),
    t4 AS (SELECT *, free AND max(c) OVER (PARTITION BY doc_id, ch_island) AND NOT c AND NOT regexp_matches(line, '^{D}+\.') AS may FROM t3),
    t5 AS (SELECT *, may AND sum(CAST(may AS INT)) OVER (PARTITION BY doc_id, ch_island ORDER BY pos) = 1 AS t FROM t4),
    t6 AS (SELECT *, free AND NOT a AND NOT c AND NOT t AND regexp_matches(line, '{section}') AS s FROM t5),
    t7 AS (SELECT *, free AND NOT a AND NOT c AND NOT t AND NOT s AND regexp_matches(line, '{sub}') AS u FROM t6),
    t8 AS (SELECT *, free AND NOT a AND NOT c AND NOT t AND NOT s AND NOT u AND regexp_matches(line, '{clause}') AS k FROM t7),
    t9 AS (SELECT *, {isl("(a OR c OR s)")} AS sec_island, {isl("(a OR c OR s OR u)")} AS sub_island, {isl("(a OR c OR s OR u OR k)")} AS block FROM t8),
    h AS (SELECT *, {held(f"CASE WHEN a THEN {annex_no} ELSE {_to_int(ex(chapter, 1))} END", "a OR c", "ch_island")} AS ch, max(a) OVER (PARTITION BY doc_id, ch_island) AS annex,
        {held(_to_int(ex(section, 1)), "s", "sec_island")} AS sec, {held(_strip(ex(section, 2)), "s", "sec_island")} AS sec_title, {held("line", "t OR a", "ch_island")} AS title_line, {held("block", "t OR a", "ch_island")} AS title_block, {held(_to_int(ex(sub, 1)), "u", "sub_island")} AS sub,
        {held(f"CASE WHEN a THEN nullif({ex(annex, 2)}, '') ELSE {ex(clause, 1)} END", "a OR k", "block")} AS clause FROM t9),
    b AS (SELECT doc_id, any_value(act_slug) AS slug, block, any_value(annex) AS annex, any_value(ch) AS ch, any_value(sec) AS sec, any_value(sec_title) AS title, any_value(title_line) AS title_line, any_value(title_block) AS title_block, any_value(sub) AS sub, any_value(clause) AS clause,
        {_strip("string_agg(line, ' ' ORDER BY pos) FILTER (NOT c AND NOT t)")} AS x FROM h GROUP BY doc_id, block),
    x1 AS (SELECT *, regexp_extract(x, '^{D}+\.{WS}*') AS pre FROM b WHERE x <> ''),
    x2 AS (SELECT *, CASE WHEN coalesce(title, '') <> '' AND pre <> '' AND starts_with(substr(x, length(pre) + 1), title)
        THEN {_strip(f"regexp_replace(substr(x, length(pre) + length(title) + 1), '^[:ः]?{WS}*', '')")} ELSE x END AS y FROM x1),
    x3 AS (SELECT *, {has("sub")} regexp_replace(y, '^\({D}+\){WS}*', '') ELSE y END AS y1 FROM x2),
    x4 AS (SELECT *, {has("clause")} regexp_replace(y1, '^\([{r.clause_class}]\){WS}*', '') ELSE y1 END AS y2 FROM x3),
    x5 AS (SELECT *, CASE WHEN contains(y2, '{r.proviso}') THEN '{r.proviso.strip()} ' || {_strip(f"string_split(y2, '{r.proviso}')[2]")} END AS proviso, CASE WHEN contains(y2, '{r.proviso}') THEN {_strip(f"string_split(y2, '{r.proviso}')[1]")} ELSE y2 END AS y3 FROM x4 WHERE {_strip("y2")} <> ''),
    x6 AS (SELECT *, CASE WHEN contains(y3, '{r.explanation}') THEN '{r.explanation.strip()} ' || {_strip(f"string_split(y3, '{r.explanation}')[2]")} END AS explanation, CASE WHEN contains(y3, '{r.explanation}') THEN {_strip(f"string_split(y3, '{r.explanation}')[1]")} ELSE y3 END AS text FROM x5)
    SELECT CAST(doc_id AS VARCHAR) AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS ord, {wanted} FROM x6"""


_PARSED = f"""concat_ws('-', coalesce(slug, '') || '-None', CASE WHEN annex THEN 'anusuchi' || coalesce(CAST(ch AS VARCHAR), '') ELSE 'ch' || ch END, 'sec' || sec, 'sub' || sub, 'cl' || clause) AS id,
      CASE WHEN annex AND sec IS NULL AND sub IS NULL AND clause IS NULL THEN 'anusuchi' ELSE CASE WHEN annex THEN 'anusuchi_' ELSE '' END ||
        CASE WHEN clause IS NOT NULL THEN 'clause' WHEN sub IS NOT NULL THEN 'subsection' ELSE 'section' END END AS type,
      coalesce(sec, -1) AS sec, clause, text, CAST(floor({_words("text")} * 1.5) AS INT) AS tokens"""
_LEVELS = """coalesce(ch, -1) AS ch, nullif(CASE WHEN block >= title_block THEN title_line END, '') AS ch_title, nullif(title, '') AS sec_title,
      coalesce(sub, -1) AS sub, proviso, explanation, '2080' AS year"""


def _front_sql() -> str:
    """Title, type, year and dates of the front lines."""
    r = NEPALI
    kind = lambda x: "CASE " + " ".join(f"WHEN contains({x}, '{w}') THEN '{k}'" for w, k in r.doc_types) + " END"
    year = lambda x: _to_int(f"regexp_extract({x}, '({D}{{4}})', 1)")
    value = r.date_value.replace("\\s", WS)
    found = lambda x: f"nullif(regexp_extract({x}, '{value}', 1), '')"

    def date(field: str) -> str:
        labels = "|".join(p for p, f in r.date_labels if f == field).replace("\\s", WS)
        return f"""replace(list_filter(list_transform(range(1, least(len(l), 20) + 1), lambda i: CASE WHEN regexp_matches(l[i], '{labels}')
            THEN coalesce({found("l[i]")}, {found("l[i + 1]")}, {found("l[i + 2]")}) END), lambda v: v IS NOT NULL)[1], ' ', '')"""

    alone = _to_int("regexp_extract(x, '^[^0-9०-९]*(" + D + "{4})[^0-9०-९]*$', 1)")
    return f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), E'\\n'), lambda x: {_strip("x")}), lambda x: x <> '') AS l FROM documents),
      b AS (SELECT *, list_filter(l[1:10], lambda x: contains(x, '{r.title_word}') AND regexp_matches(x, '{D}{{4}}'))[1] AS named,
        list_filter(range(1, least(len(l), 15) + 1), lambda i: {kind("l[i]")} IS NOT NULL)[1] AS oi FROM a),
      c AS (SELECT *, l[oi] AS other, list_filter(list_transform(l[oi + 1 : oi + 3], lambda x: {alone}), lambda y: y IS NOT NULL)[1] AS alone,
        {date("date_published")} AS date_published, {date("date_commenced")} AS date_commenced FROM b)
      SELECT doc_id, coalesce(CASE WHEN named IS NOT NULL THEN {year("named")} WHEN other IS NOT NULL THEN coalesce({year("other")}, alone) END, {year("coalesce(date_commenced, date_published)")}) AS bs_year,
        CASE WHEN named IS NULL AND other IS NOT NULL THEN {kind("other")} ELSE 'act' END AS type, date_published, date_commenced, coalesce(named, other, '{metadata.UNKNOWN_TITLE}') AS act_title FROM c"""


def oracle_sql() -> dict[str, str]:
    clean = "coalesce(text, '')"
    clean = f"regexp_replace({clean}, '(?i){NEPALI.site}', '', 'g')"
    clean = f"regexp_replace({clean}, '{NEPALI.footnote}', '', 'g')"
    clean = rf"regexp_replace({clean}, '(?m)^\s*{D}+\s*$', '', 'g')"
    clean = rf"regexp_replace(regexp_replace({clean}, ' +', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g')"
    groups = " UNION ALL ".join(
        f"SELECT chunk_row_id, ner_score, '{g}' AS keyword_group, unnest(list_distinct(regexp_extract_all(text, '{'|'.join(ws)}'))) AS keyword FROM passed"
        for g, ws in NEPALI.keyword_groups.items()
    )
    ref = NEPALI.reference.replace(r"\s", WS)
    code = "CASE word " + " ".join(f"WHEN '{w}' THEN '{c}'" for w, c in NEPALI.reference_codes.items()) + " END"
    uuid = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
        ['8','9','a','b'][1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4] || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""
    office, price, dur, pre = (_strip(x) for x in ("office", "price", "duration_days", "prerequisites"))
    rejects = lambda x, ps: "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in ps) + ")"
    services = ", ".join(f"'{s}'" for s in NEPALI.service_names)
    before, after = NEPALI.currency_before, NEPALI.currency_after
    fees = rf"""SELECT output_id, CAST(i - 1 AS INT) AS fee_pos, raws[i] AS amount_raw, coalesce({_to_int("nums[i]", "BIGINT")}, -1) AS amount_npr FROM (
      SELECT output_id, CASE WHEN len(r) > 0 THEN r ELSE [{price}] END AS raws, CASE WHEN len(r) > 0 THEN n ELSE [NULL] END AS nums FROM (
        SELECT output_id, price, list_concat(regexp_extract_all(price, '{before}', 0), regexp_extract_all(price, '{after}', 0)) AS r,
          list_concat(regexp_extract_all(price, '{before}', 1), regexp_extract_all(price, '{after}', 1)) AS n FROM ner_outputs WHERE coalesce({price}, '') <> '')),
      unnest(range(1, len(raws) + 1)) AS u(i)"""
    n = lambda c: f"coalesce(CAST({c} AS VARCHAR), '?')"
    crumb = f"""concat_ws(' → ', 'परिच्छेद ' || {n("hierarchy.ch")} || ': ' || hierarchy.ch_title, 'दफा ' || {n("hierarchy.sec")} || ': ' || hierarchy.sec_title,
        'उपदफा (' || hierarchy.sub || ')', 'खण्ड (' || hierarchy.clause || ')')"""
    lists = {"all_documents": "documents_required", "all_steps": "steps", "durations": "[duration]", "prerequisites": "[prerequisites]"}
    counts = ", ".join(f"(SELECT count(*) FROM ({_distinct_list(c)}) x WHERE x.act_slug = g.act_slug AND x.task_name = g.task_name) AS n_{name}" for name, c in lists.items())
    titles = " UNION ALL ".join(f"SELECT chunk_row_id, replace('{t}', '{{}}', hierarchy.sec_title) AS query FROM chunks WHERE coalesce(hierarchy.sec_title, '') <> ''" for t in training.TITLE_TEMPLATES)
    return {
        "clean_documents": f"SELECT doc_id, {_strip(clean)} AS cleaned FROM documents",
        "act_slugs": r"SELECT act_id, lower(regexp_replace(regexp_replace(act_slug || ' Copy', '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug, act_slug || '-' || coalesce(CAST(bs_year AS VARCHAR), 'None') AS prefix FROM acts",
        "digits_to_int": f"SELECT act_id, coalesce({_to_int('title')}, -1) AS in_title, coalesce({_to_int('date_published', 'BIGINT')}, -1) AS in_date FROM acts",
        "chunk_stats": f"SELECT chunk_row_id, CAST(length(text) AS INT) AS characters, CAST({_words('text')} AS INT) AS n_words, CAST(floor({_words('text')} * 1.5) AS INT) AS tokens FROM chunks WHERE text IS NOT NULL",
        "chunk_references": rf"""SELECT chunk_row_id, CAST(i - 1 AS INT) AS ref_pos, CASE c WHEN 'sec' THEN 'section' WHEN 'ch' THEN 'chapter' ELSE 'subsection' END AS ref_type,
            act_slug || '-None-' || c || CASE WHEN c = 'cl' THEN v ELSE coalesce(CAST({_to_int("v")} AS VARCHAR), v) END AS ref_id, w AS ref_text FROM (
              SELECT chunk_row_id, act_slug, i, whole[i] AS w, regexp_replace(val[i], '[()]|{WS}', '', 'g') AS v, {code.replace("CASE word", "CASE words[i]")} AS c FROM (
                SELECT chunk_row_id, act_slug, regexp_extract_all(text, '{ref}', 0) AS whole, regexp_extract_all(text, '{ref}', 1) AS words, regexp_extract_all(text, '{ref}', 2) AS val FROM chunks),
              unnest(range(1, len(whole) + 1)) AS u(i))""",
        "document_blocks": f"WITH {_lines_sql()} SELECT doc_id AS doc, count(*) AS n_lines, CAST(min(pos) AS INT) AS first_pos FROM body GROUP BY doc_id",
        "parse_documents": _parse_sql(_PARSED),
        "parsed_hierarchy": _parse_sql(_LEVELS),
        "front_metadata": _front_sql(),
        "amendment_entries": f"""SELECT act_id, CAST(i - 1 AS INT) AS pos, CASE WHEN d <> '' THEN {_strip("substring(line, 1, strpos(line, d) - 1)")} ELSE line END AS ref, replace(d, ' ', '') AS date FROM (
            SELECT *, regexp_extract(line, '{NEPALI.date_value.replace(chr(92) + "s", WS)}', 1) AS d FROM (
              SELECT act_id, i, {_strip("coalesce(amended_refs[i].ref, '') || '  ' || coalesce(amended_refs[i].date, '')")} AS line FROM acts, unnest(range(1, len(amended_refs) + 1)) AS u(i)))""",
        "definition_queries": " UNION ALL ".join(
            f"""SELECT chunk_row_id, replace('{t}', '{{}}', regexp_replace(hierarchy.sec_title, '["”]', '', 'g')) AS query FROM chunks WHERE length(regexp_replace(hierarchy.sec_title, '["”]', '', 'g')) BETWEEN 1 AND 80""" for t in training.DEFINITION_TEMPLATES
        ),
        "negative_counts": f"""WITH k AS (SELECT chunk_row_id, coalesce(act_slug, '') AS act, coalesce(hierarchy.ch, -1) AS ch, coalesce(hierarchy.sec, -1) AS sec FROM chunks),
            n AS (SELECT chunk_row_id, count(*) OVER () AS t, count(*) OVER (PARTITION BY act) AS a, count(*) OVER (PARTITION BY act, ch) AS c, count(*) OVER (PARTITION BY act, ch, sec) AS s FROM k),
            f AS (SELECT *, least({(training.NEGATIVES + 1) // 2}, c - s) AS f FROM n), g AS (SELECT *, least({training.NEGATIVES} - f, t - a) AS g FROM f), h AS (SELECT *, least({training.NEGATIVES} - f - g, a - c) AS h FROM g)
            SELECT * FROM (SELECT chunk_row_id, least({training.NEGATIVES} - g - h, c - s) AS n_hard, g + h AS n_other FROM h) WHERE n_hard + n_other > 0""",
        "triple_texts": f"""SELECT query, concat_ws(' | ', CASE WHEN {crumb} = '' THEN '—' ELSE {crumb} END, text) AS positive, id AS chunk_id FROM ({titles}) JOIN chunks USING (chunk_row_id)""",
        "keyword_scores": f"SELECT chunk_row_id, {_score()} AS ner_score FROM chunks",
        "relevant_chunks": f"WITH passed AS (SELECT * FROM (SELECT chunk_row_id, text, {_score()} AS ner_score FROM chunks) WHERE ner_score >= 2) {groups}",
        "keyword_histogram": f"SELECT ner_score, count(*) AS n FROM (SELECT {_score()} AS ner_score FROM chunks) GROUP BY ALL",
        "filter_stats": f"""SELECT total, passed, total - passed AS rejected, CASE WHEN total > 0 THEN round((total - passed) / total * 100, 1) ELSE 0.0 END AS filter_rate_pct FROM (
            SELECT count(*) AS total, CAST(coalesce(sum(CAST({_score()} >= 2 AS INT)), 0) AS BIGINT) AS passed FROM chunks)""",
        "context_windows": f"""WITH f AS (SELECT * FROM (SELECT chunk_row_id, act_slug, text, hierarchy.sec AS sec, {_score()} AS s FROM chunks) WHERE s >= 2),
            b AS (SELECT *, coalesce(CAST(sec <> lag(sec) OVER w AS INT), 1) AS brk FROM f WINDOW w AS (PARTITION BY act_slug ORDER BY chunk_row_id)),
            i AS (SELECT *, sum(brk) OVER (PARTITION BY act_slug ORDER BY chunk_row_id) AS island FROM b),
            p AS (SELECT *, (row_number() OVER (PARTITION BY act_slug, island ORDER BY chunk_row_id) - 1) // 3 AS part FROM i)
            SELECT act_slug, min(chunk_row_id) AS chunk_row_id, CAST(sum(length(coalesce(text, ''))) + 2 * (count(*) - 1) AS INT) AS n_chars, CAST(count(*) AS INT) AS n_merged FROM p GROUP BY act_slug, island, part""",
        "embedding_texts": """SELECT chunk_row_id, concat_ws(' | ', 'परिच्छेद: ' || hierarchy.ch_title, 'दफा: ' || hierarchy.sec_title, 'उपदफा: (' || hierarchy.sub || ')', 'खण्ड: (' || hierarchy.clause || ')',
            coalesce(text, ''), CASE WHEN len(list_filter(provisos, lambda x: x IS NOT NULL)) > 0 THEN array_to_string(list_filter(provisos, lambda x: x IS NOT NULL), ' | ') END,
            CASE WHEN len(list_filter(explanations, lambda x: x IS NOT NULL)) > 0 THEN array_to_string(list_filter(explanations, lambda x: x IS NOT NULL), ' | ') END) AS embedding_text FROM chunks""",
        "breadcrumbs": f"SELECT chunk_row_id, CASE WHEN {crumb} = '' THEN '—' ELSE {crumb} END AS path, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '...' ELSE text END AS preview FROM chunks",
        "clause_refs": _CLAUSE_REF,
        "point_ids": f"SELECT chunk_row_id, {uuid} AS point_id FROM (SELECT chunk_row_id, sha1(unhex('{text_fns.URL_NAMESPACE}') || encode(id)) AS h FROM chunks)",
        "upsert_last_wins": "SELECT id, max(chunk_row_id) AS chunk_row_id, arg_max(CAST(coalesce(length(text), -1) AS INT), chunk_row_id) AS n_chars FROM chunks GROUP BY id",
        "upsert_twice": """SELECT id, coalesce(max(CASE WHEN chunk_row_id % 2 = 0 THEN chunk_row_id END), max(chunk_row_id)) AS chunk_row_id FROM chunks GROUP BY id""",
        "collection_info": "SELECT act_slug, count(DISTINCT id) AS n_points, count(*) AS n_rows FROM chunks GROUP BY act_slug",
        "dense_cosine_topk": _topk(_dense_sql("list_cosine_similarity")),
        "dense_dot_topk": _topk(_dense_sql("list_dot_product")),
        "dense_filtered_topk": _topk(_dense_sql("list_cosine_similarity", "c.label = 1")),
        "dense_threshold": _topk(f"SELECT * FROM ({_dense_sql('list_cosine_similarity')}) WHERE score >= 0.2"),
        "sparse_topk": f"WITH {_BAGS} {_topk('SELECT * FROM sparse')}",
        "hybrid_rrf": f"""WITH {_BAGS}, dense AS ({_dense_sql("list_cosine_similarity")}),
            both_ AS (SELECT qid, docid, rank FROM {_ranked("dense", 2 * K)} UNION ALL SELECT qid, docid, rank FROM {_ranked("sparse", 2 * K)})
            {_topk("SELECT qid, docid, round(sum(1.0 / (60 + rank)), 9) AS score FROM both_ GROUP BY qid, docid")}""",
        "hybrid_weighted": f"""WITH {_BAGS}, dense AS ({_dense_sql("list_dot_product")})
            {_topk("SELECT d.qid, d.docid, round(1.0 * d.score + 0.3 * coalesce(s.score, 0), 6) AS score FROM dense d LEFT JOIN sparse s ON d.qid = s.qid AND d.docid = s.docid")}""",
        "sparse_zeros_topk": f"""WITH b AS (SELECT docid, token, CAST(count(*) AS DOUBLE) AS w FROM (SELECT doc_id AS docid, unnest(string_split(text, ' ')) AS token FROM documents) WHERE length(token) > 9 GROUP BY ALL),
            pairs AS (SELECT q.docid AS qid, c.docid, sum(q.w * c.w) AS s FROM b q JOIN b c USING (token) WHERE q.docid % {EVERY} = 0 GROUP BY ALL)
            {_topk(f"SELECT q.qid, d.doc_id AS docid, coalesce(p.s, 0.0) AS score FROM (SELECT DISTINCT docid AS qid FROM b WHERE docid % {EVERY} = 0) q CROSS JOIN documents d LEFT JOIN pairs p ON p.qid = q.qid AND p.docid = d.doc_id")}""",
        "two_stage": _second_stage(f"""dense AS ({_dense_sql("list_cosine_similarity")}),
            both_ AS (SELECT qid, docid, rank FROM {_ranked("dense", 8 * K)} UNION ALL SELECT qid, docid, rank FROM {_ranked("sparse", 8 * K)}),
            fused AS (SELECT qid, docid, round(sum(1.0 / (60 + rank)), 9) AS score FROM both_ GROUP BY qid, docid),""", "fused"),
        "reranked": _second_stage("", "sparse"),
        "eval_metrics": _metric_sql(),
        "gold_matched": "SELECT chunk_id AS docid, entity_id AS ord, 'q_' || (row_number() OVER (ORDER BY entity_id) - 1) AS qid FROM entities WHERE chunk_id IN (SELECT id FROM chunks)",
        "gold_skipped": "SELECT entity_id AS ord, chunk_id AS docid FROM entities e WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.id = e.chunk_id)",
        "corpus_last_text": "SELECT id AS docid, arg_max(coalesce(text, ''), chunk_row_id) AS text, min(chunk_row_id) AS ord FROM chunks GROUP BY id",
        "cleaned_outputs": f"""SELECT output_id, CASE WHEN NOT {rejects(office, NEPALI.office_rejects)} AND length({office}) >= 3 THEN {office} END AS office,
            CASE WHEN {_any(price, NEPALI.fee_words)} AND NOT {_any(price, NEPALI.penalty_words)} THEN {price} END AS price,
            CASE WHEN {_any(dur, NEPALI.time_words)} THEN {dur} END AS duration, CASE WHEN length({pre}) >= 10 THEN {pre} END AS prerequisites,
            CAST(coalesce((SELECT count(*) FROM (SELECT {_strip("x")} AS y FROM unnest(documents_required) AS u(x)) WHERE length(y) > 2 AND NOT {rejects("y", NEPALI.document_rejects)} AND y NOT IN ({services})), 0) AS INT) AS n_documents,
            CAST(coalesce((SELECT count(*) FROM unnest(steps) AS u(x) WHERE {_words("x")} >= 4), 0) AS INT) AS n_steps FROM ner_outputs""",
        "parsed_answers": f"""SELECT output_id, office, price, CAST(coalesce((SELECT count(*) FROM unnest(documents_required) AS u(x) WHERE length({_strip("x")}) > 2), 0) AS INT) AS n_documents,
            CAST(coalesce((SELECT count(*) FROM unnest(steps) AS u(x) WHERE {_words("x")} >= 2), 0) AS INT) AS n_steps FROM ner_outputs""",
        "parsed_fees": fees,
        "office_levels": f"""SELECT output_id, {office} AS name, CASE WHEN {_any("office", NEPALI.province_words)} THEN 'प्रदेश' WHEN {_any("office", NEPALI.local_words)} THEN 'स्थानीय' ELSE 'केन्द्र' END AS level
            FROM ner_outputs WHERE coalesce({office}, '') <> ''""",
        "task_names": f"WITH {_TASKS} SELECT entity_id, task_name FROM tasks",
        "workflows": f"""WITH {_TASKS} SELECT act_slug, task_name,
            arg_min(regexp_extract(clause_ref, 'sec[0-9]+\\s*\\((.*?)\\)', 1), entity_id) FILTER (regexp_matches(clause_ref, 'sec[0-9]+\\s*\\((.*?)\\)')) AS description, count(*) AS n_entities,
            CAST(count(DISTINCT CASE WHEN coalesce(office.name, '') <> '' THEN office.name END) AS BIGINT) AS n_offices, {counts},
            (SELECT count(*) FROM (SELECT DISTINCT CASE WHEN coalesce(f.amount_raw, '') = '' THEN 'e' || eid || '-' || i ELSE 'r' || f.amount_raw END FROM (
               SELECT t2.entity_id AS eid, i, t2.price_fees[i] AS f FROM tasks t2, unnest(range(1, len(t2.price_fees) + 1)) AS u(i) WHERE t2.act_slug = g.act_slug AND t2.task_name = g.task_name))) AS n_all_fees
            FROM tasks g GROUP BY act_slug, task_name""",
        "workflow_documents": f"WITH {_TASKS} SELECT act_slug, task_name, CAST(row_number() OVER (PARTITION BY act_slug, task_name ORDER BY place) - 1 AS INT) AS pos, item AS document FROM ({_distinct_list('documents_required')})",
        "workflow_sources": f"WITH {_TASKS} SELECT act_slug, task_name, CAST(row_number() OVER (PARTITION BY act_slug, task_name ORDER BY entity_id) - 1 AS INT) AS position, chunk_id FROM tasks",
        "distinct_documents": f"""SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY place) - 1 AS INT) AS pos, document FROM (
            SELECT entity_id, document, min(i) AS place FROM (SELECT entity_id, i, {_strip("documents_required[i]")} AS document FROM entities, unnest(range(1, len(documents_required) + 1)) AS u(i))
            WHERE document IS NOT NULL AND document <> '' GROUP BY ALL)""",
        "entity_chunks": "SELECT e.entity_id, e.chunk_id, c.chunk_row_id, c.type AS chunk_type FROM entities e JOIN chunks c ON e.chunk_id = c.id",
        "otsu_thresholds": _otsu(),
        "title_queries": titles,
        "reference_queries": "SELECT DISTINCT chunk_row_id, refs[i].text AS query FROM chunks, unnest(range(1, len(refs) + 1)) AS u(i) WHERE refs[i].text <> ''",
    }
