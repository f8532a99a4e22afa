"""Embedding and search queries (E, J02)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from eligo.operators import ann as ANN
from eligo.operators import catalog as C
from eligo.operators import trigrams as T
from eligo.operators import vectors as VX
from eligo.plans import search as P
from eligo.registry.common import Registry, big, c
from eligo.session import new_table_path

DIM = 64
K = 10
TEXT_SQL = """concat_ws(chr(10), 'Scheme: ' || name, case when ministry <> '' then 'Ministry: ' || ministry end, case when department <> '' then 'Department: ' || department end,
 case when description <> '' then 'Description: ' || left(description, 500) end, case when len(beneficiary_types) > 0 then 'Beneficiaries: ' || array_to_string(beneficiary_types, ', ') end,
 case when len(gender_eligibility) > 0 and not list_contains(gender_eligibility, 'Any') then 'Target gender: ' || array_to_string(gender_eligibility, ', ') end,
 case when len(social_categories) > 0 then 'Social categories: ' || array_to_string(social_categories, ', ') end,
 case when len(business_types) > 0 then 'Business types: ' || array_to_string(business_types, ', ') end,
 'Eligibility: ' || left(eligibility_text, 400), case when len(states) > 0 then 'States: ' || array_to_string(states[1:5], ', ') end,
 case when government_level <> '' then 'Government level: ' || government_level end, case when udyam_required then 'Udyam registration required' end)"""
EXACT = f"""ex as (select q.vec_id as qid, cast(e.vec_id as varchar) as scheme_id,
 round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 6) as similarity
 from embeddings q, embeddings e join f_schemes s on s.id = cast(e.vec_id as varchar) where s.status = 'active'),
rk as (select cast(qid as varchar) as query_id, scheme_id, similarity, row_number() over (partition by qid order by similarity desc, scheme_id) as rank from ex)"""
# every benchmark text, every kind and brand and every pair of words of a part's name, and patterns with wildcards
TEXTS_SQL = """select 'b' || item_id as query_id, text from benchmark
 union all select distinct 'k' || p_type, p_type from part union all select distinct 'm' || p_brand, lower(p_brand) from part
 union all select distinct 'n' || p_name, ' ' || p_name || '  ' from part
 union all select distinct 'p' || p_name, replace(p_name, ' ', '%') || '%#_' from part
 union all select distinct 'q' || left(p_name, 2), left(p_name, 2) from part"""


def vectors(t):
    """Stored vectors: every embedding belongs to the scheme of its number."""
    return t.embeddings.select(c("vec_id").cast("string").alias("scheme_id"), "embedding")


def asked(t):
    return t.embeddings.select(c("vec_id").cast("string").alias("query_id"), "embedding")


def exact(t):
    return VX.cosine_top_k(asked(t), VX.active_vectors(vectors(t), t.f_schemes), K)


_INDEXES: dict[tuple[str, str], ANN.Index] = {}  # stored ones, by session and tables


def vector_index(t) -> ANN.Index:
    """The index over the vectors of active schemes, built and stored once for a session's tables."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _INDEXES:
        _INDEXES[key] = ANN.build(VX.active_vectors(vectors(t), t.f_schemes), new_table_path(t.spark, "ann"), DIM)
    return _INDEXES[key]


_TRIGRAMS: dict[tuple[str, str], T.Index] = {}


def trigram_index(t) -> T.Index:
    """The index over the catalog's texts, built and stored once for a session's tables."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _TRIGRAMS:
        _TRIGRAMS[key] = T.build(t.f_schemes, new_table_path(t.spark, "trigrams"))
    return _TRIGRAMS[key]


def texts(t):
    """The queries of TEXTS_SQL."""
    part = t.part
    name = c("p_name")

    def asked(df, key, of, text):
        return df.select(F.concat(F.lit(key), of).alias("query_id"), text.alias("text"))

    parts = [
        asked(part, "k", c("p_type"), c("p_type")), asked(part, "m", c("p_brand"), F.lower("p_brand")),
        asked(part, "n", name, F.concat(F.lit(" "), name, F.lit("  "))),
        asked(part, "p", name, F.concat(F.replace(name, F.lit(" "), F.lit("%")), F.lit("%#_"))),
        asked(part, "q", F.left(name, F.lit(2)), F.left(name, F.lit(2)))]
    out = asked(t.benchmark, "b", c("item_id"), c("text"))
    for p in parts:
        out = out.unionByName(p.distinct())
    return out


def _plain(texts: pd.Series) -> pd.Series:
    """A stand-in for a user's model: length and letter counts; short texts fail."""
    return texts.map(lambda s: np.array([len(s), s.count("e"), 1.0], dtype="float32") if len(s) >= 200 else None)


def register(r: Registry) -> None:
    r.add("e01_embedding_text", lambda t: t.f_schemes.select("id", VX.embedding_text(t.f_schemes).alias("text")),
          f"select id, {TEXT_SQL} as text from f_schemes", "f_schemes")
    r.add("e02_quality_gate", lambda t: t.f_schemes.where(VX.worth_embedding()).select("id"),
          "select id from f_schemes where data_quality_score >= 40", "f_schemes")

    def unit_length(df, key):
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        return df.select(key, big("embedding_dim").alias("dim"), "embedding_model", F.round(norm, 3).alias("norm"))

    r.add("e03_embed_documents", lambda t: unit_length(VX.embed(t.documents, "text"), "doc_id"),
          "select doc_id, cast(768 as bigint) dim, 'hashed-tf' embedding_model, cast(1 as double) norm from documents")
    r.add("e04_embedding_cache", lambda t: VX.to_embed(t.f_schemes, t.f_schemes.select(
        c("id").alias("scheme_id"), F.lit(VX.HASHED).alias("embedding_model"),
        F.when(c("age_min") > 22, c("content_hash")).otherwise("old").alias("content_hash"))).select("id"),
        "select id from f_schemes where data_quality_score >= 40 and not coalesce(age_min > 22, false)", "f_schemes")

    def twice(t):
        both = vectors(t).withColumns({"embedding_model": F.lit("m1"), "version": F.lit(1)})
        later = both.withColumn("version", F.lit(2))
        other = both.withColumn("embedding_model", F.lit("m2"))
        return VX.one_per_model(both.unionByName(later).unionByName(other), "version").select(
            "scheme_id", "embedding_model", big("version").alias("version"))

    r.add("e05_one_per_model", twice, """select cast(vec_id as varchar) scheme_id, 'm1' embedding_model, cast(2 as bigint) as version from embeddings
        union all select cast(vec_id as varchar), 'm2', cast(1 as bigint) from embeddings""")
    r.add("e06_embed_queries", lambda t: unit_length(VX.embed(t.benchmark, "text", dim=1536), "item_id"),
          "select item_id, cast(1536 as bigint) dim, 'hashed-tf' embedding_model, cast(1 as double) norm from benchmark")
    r.add("e07_cosine_top_k", lambda t: exact(t).select("query_id", big("rank").alias("rank"), "scheme_id", "similarity"),
          f"with {EXACT} select query_id, rank, scheme_id, similarity from rk where rank <= {K}", "f_schemes")

    def approximate(t, **how):
        return ANN.top_k(asked(t), vector_index(t), K, **how)

    r.add("e08_approximate_top_k", lambda t: approximate(t).select("query_id", big("rank").alias("rank"), "scheme_id", "similarity"))
    r.add("e08_all_cells", lambda t: approximate(t, probes=1 << 30, shortlist=0).select(
        "query_id", big("rank").alias("rank"), "scheme_id", "similarity"),
        f"with {EXACT} select query_id, rank, scheme_id, similarity from rk where rank <= {K}", "f_schemes")
    r.add("e08_recall", lambda t: VX.recall(approximate(t), exact(t)))
    r.add("e08_index_rows", lambda t: vector_index(t).table("codes").join(
        vector_index(t).table("vectors"), ["scheme_id", "cell"]).select("scheme_id", big(F.octet_length("code")).alias("bytes")),
        f"select s.id as scheme_id, cast({DIM // 4} as bigint) as bytes from f_schemes s join embeddings e on cast(e.vec_id as varchar) = s.id where s.status = 'active'", "f_schemes")
    r.add("e09_hydrate", lambda t: VX.hydrate(exact(t), C.response(t.f_schemes)).select(
        "query_id", big("rank").alias("rank"), "id", "title", "ministry_or_org"),
        f"""with {EXACT} select query_id, rank, id, name as title, coalesce(nullif(ministry,''), nullif(department,''), 'Government of India') ministry_or_org
        from rk join f_schemes on id = scheme_id where rank <= {K}""", "f_schemes")

    def stored(t):
        rows = VX.embedding_rows(t.f_schemes, dim=32)
        path = new_table_path(t.spark, "vectors")
        VX.store(rows, path)
        back = t.spark.read.parquet(path)
        return back.select("scheme_id", "embedding_model", big("dim").alias("dim"), "embedding_text")

    r.add("a29_vector_sink", stored, f"select id scheme_id, 'hashed-tf' embedding_model, cast(32 as bigint) dim, left({TEXT_SQL}, 2000) as embedding_text "
          "from f_schemes where data_quality_score >= 40", "f_schemes")
    fields = [f"{x} ilike '%' || text || '%'" for x in ("name", "description", "ministry", "scheme_code")]
    page = "data_quality_score desc, created_at desc, id"
    words_sql = f"""texts as (select query_id, trim(text) as text from ({TEXTS_SQL})),
        kw as (select query_id, row_number() over (partition by query_id order by {page}) as rank, id as scheme_id
         from texts join f_schemes on {' or '.join(fields)} where status = 'active')"""
    r.add("e10_keyword_listing", lambda t: P.keyword_top(t.f_schemes, texts(t), trigram_index(t), 20).select(
        "query_id", big("rank").alias("rank"), "scheme_id"),
        f"with {words_sql} select * from kw where rank <= 20", "f_schemes")
    r.add("f06_trigram_matches", lambda t: T.matches(texts(t), trigram_index(t)).groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id")),
        f"with texts as (select query_id, trim(text) as text from ({TEXTS_SQL})) select query_id, count(*) as n, min(id) as first_id from texts join f_schemes on {' or '.join(fields)} group by 1", "f_schemes")

    def hybrid(t):
        # the vectors asked with come out of the data: the mean vector of every label, with a text
        means = t.embeddings.groupBy("label").agg(F.array(*[F.avg(c("embedding")[i]) for i in range(DIM)]).alias("embedding"))
        asked = means.select(F.concat(F.lit("v"), "label").alias("query_id"), F.lit("anything").alias("text"), "embedding")
        no_vector = F.lit(None).cast("array<double>")
        zero = F.array_repeat(F.lit(0.0), DIM)
        worded = texts(t).withColumn("embedding", F.when(c("query_id") < "p", no_vector).otherwise(zero))
        blank = asked.select(F.concat(F.lit("blank"), "query_id").alias("query_id"), F.lit("  ").alias("text"), "embedding")
        return P.hybrid(t.f_schemes, vectors(t), asked.unionByName(worded).unionByName(blank), trigram_index(t), K).select(
            "query_id", big("rank").alias("rank"), "scheme_id", "method")

    r.add("e10_hybrid", hybrid, f"""with {words_sql},
        m as (select label, list(x order by i) v from (select label, i, avg(embedding[i]) x from embeddings, unnest(range(1, {DIM + 1})) as u(i) group by all) group by label),
        vx as (select label, scheme_id, row_number() over (partition by label order by sim desc, scheme_id) as rank from (select label, scheme_id,
         round(list_cosine_similarity(e, v), 6) sim from m, (select cast(vec_id as varchar) scheme_id, cast(embedding as double[]) e from embeddings)) join f_schemes on id = scheme_id where status = 'active')
        select 'blankv' || label as query_id, rank, scheme_id, 'listing' as method
         from m, (select row_number() over (order by {page}) as rank, id scheme_id from f_schemes where status = 'active') where rank <= {K}
        union all select query_id, rank, scheme_id, 'keyword' from kw where rank <= {K}
        union all select 'v' || label, rank, scheme_id, 'vector' from vx where rank <= {K}""", "f_schemes")
    r.add("j02_embedding_provider", lambda t: VX.embed(t.documents, "text", F.pandas_udf(_plain, "array<float>"), "plain").select(
        "doc_id", big("embedding_dim").alias("dim"), "embedding_model", F.coalesce(c("embedding")[0].cast("double"), F.lit(-1.0)).alias("length")),
        "select doc_id, cast(case when len(text) >= 200 then 3 else 0 end as bigint) dim, case when len(text) >= 200 then 'plain' else '' end embedding_model, "
        "cast(case when len(text) >= 200 then len(text) else -1 end as double) as length from documents")
