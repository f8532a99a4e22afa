"""One registered query per operator of this subpackage, with SQL checks where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from eligo.llm import bitplanes, chat, jaccard, langid, lines, mixing, permutations, pieces, quality, repair, suffixes, suffixtree, warc
from eligo.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutations.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.passages(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with texts as (
  select row_number() over () as row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
stretches as (
  select row, doc_id, i, hash(array_to_string(w[i + 1:i + 50], ' ')) as s
  from (select row, doc_id, w, unnest(range(0, len(w) - 49)) as i from texts where len(w) >= 50)),
twice as (select s from stretches group by s having count(distinct row) > 1),
hits as (select row, doc_id, i from stretches join twice using (s)),
marked as (
  select *, case when i <= lag(i) over (partition by row order by i) + 50 then 0 else 1 end as fresh from hits),
islands as (select *, sum(fresh) over (partition by row order by i) as island from marked)
select doc_id, min(i) as start_word, max(i) - min(i) + 50 as n_words
from islands group by row, doc_id, island
"""


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = chat.load_ranks()
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.sql("select * from values (-1L, 0L, 'user', :t), (-1L, 1L, 'assistant', :t) as v(conv_id, turn, role, text)", args={"t": probe}))
    return chat.read_back(chat.format_conversations(turns, ranks), ranks)


OP7_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(20 + length(role) + length(text)
         + len(regexp_extract_all(role || chr(10) || text, '\\|<s>|\[INST\]|\[/INST\]|</s>|<<SYS>>|<</SYS>>'))) as bigint) as formatted_chars
from turns group by conv_id
"""


def op8_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_packages(warc.write_packages(table(spark, sf_dir, "pages")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.Vocabulary.load())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with recursive tokens as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select distinct doc_id, hash(array_to_string(w[i:i + 4], ' ')) as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from tokens where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select s from shingles group by s having count(*) > 1),
posts as materialized (select doc_id, s from shingles join shared using (s)),
common_grams as (
  select a.doc_id as x, b.doc_id as y, count(*) as common
  from posts a join posts b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as materialized (
  select x, y from common_grams join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * common >= 75 * (p.n + q.n - common)),
ways as materialized (select x, y from links union all select y, x from links),
reach as (
  select doc_id as x, doc_id as y from documents
  union
  select reach.x, ways.y from reach join ways on reach.y = ways.x)
select d.doc_id, coalesce(n, 0) as n_shingles, min(reach.y) as component_id
from documents d join reach on reach.x = d.doc_id left join sizes using (doc_id)
group by d.doc_id, n
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
doomed as (
  select k, max(doc_id) as last from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
judged as (
  select keyed.*, coalesce(doc_id < last, false) as drops from keyed left join doomed using (k))
select doc_id, count(*) as n_lines, count(*) filter (where drops) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not drops), '')) as kept_sha256
from judged group by doc_id
"""

def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.with_inertia(*bitplanes.cluster(table(spark, sf_dir, "embeddings")))


def _op11_sql() -> str:
    """The seeds, the rounds one after the other, and the sums."""
    def assigned(i: int) -> str:
        """Distance and number in one integer, so that the least is the nearest and the first of equals."""
        return f"""
a{i} as materialized (
  select r, any_value(kept.v) as v, min(1000::hugeint * list_sum(list_transform(range(1, 65),
           lambda j: (kept.v[j] - c{i}.v[j]) * (kept.v[j] - c{i}.v[j]))) + k) as best
  from kept, c{i} group by r),"""

    def moved(i: int) -> str:
        return f"""
m{i} as (
  select k, list(f order by j) as v from (
    select k, j, cast((s - ((s % n) + n) % n) // n as bigint) as f
    from (select best % 1000 as k, j, sum(v[j]) as s, count(*) as n from a{i}, range(1, 65) t(j) group by 1, 2)) group by k),
c{i + 1} as materialized (select c{i}.k, coalesce(m{i}.v, c{i}.v) as v from c{i} left join m{i} using (k)),"""

    return """
with kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
ranked as (select v, row_number() over (order by sha256('1:' || vec_id) nulls last) - 1 as k from kept),
c0 as materialized (select k, v from ranked where k < 16),""" + "".join(
        assigned(i) + moved(i) for i in range(bitplanes.ROUNDS)) + assigned(bitplanes.ROUNDS) + f"""
found as (select vec_id, best % 1000 as k, cast(best // 1000 as bigint) as d from a{bitplanes.ROUNDS} join kept using (r))
select vec_id, cast(k as integer) as cluster, d as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia,
       cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c{bitplanes.ROUNDS}.v, ',')) as centroid_sha256
from found join c{bitplanes.ROUNDS} using (k)
"""


def op12_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, rare = suffixtree.learn(docs.filter(~suffixtree.held_out()))
    return suffixtree.score(docs, model, rare).select(
        "doc_id", suffixtree.held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.audits(repair.damage(turns), turns)


def _op13_sql() -> str:
    """Cheapest edits row by row: each state's best so far is one string, ten digits of cost and the edits' letters, so
    that the least string is the cheapest and the first of equals. Null stands for none."""
    def step(best: str, cost: str, letter: str) -> str:
        return f"lpad(cast(cast({best}[:10] as bigint) + {cost} as varchar), 10, '0') || {best}[11:] || '{letter}'"

    inserted = f"""select conv_id, i, s0, s1, least(s2, {step('s0', '2', 'I')}, {step('s1', '2', 'I')}, {step('s3', '2', 'I')}) as s2, s3 from best"""
    both = f"select conv_id, i, s0, s1, s2, least(s3, {step('s2', '2', 'I')}) as s3 from ({inserted})"
    free = "case when fault not in (1, 2) then {} end".format
    kept, given = (lambda s: step(s, "late", "K")), (lambda s: step(s, "2 + late", "R"))
    to_user = ", ".join(f"case when x = 'u' then {kept(s)} end, {given(s)}" for s in ("s0", "s1", "s3"))
    return rf"""
with recursive crc as (
  select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
           lambda a, _: xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end))) as t),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
hits as (
  select keyed.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: cast(ascii(x) as bigint))),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as h from keyed, crc),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
         case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from hits where h <> 0
  union all select conv_id, turn, role, text from hits where h = 3),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, role[:1] as x from damaged),
rows as materialized (
  select *, case when not regexp_matches(text, '[^ 	-
]') then 1
                 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
                 when not regexp_matches(text, '[.!?][ 	-
]*$') then 3 else 0 end as fault,
         coalesce(lag(x) over (partition by conv_id order by i) || x not in ('su', 'ua', 'au'), false) as wrong from placed),
best as (
  select distinct conv_id, 0::bigint as i, '0000000000' as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from rows
  union all
  select b.conv_id, r.i, {step('s0', '3', 'D')},
         least({step('s1', '3', 'D')}, {free(f"case when x = 's' then {kept('s0')} end")}),
         least({step('s2', '3', 'D')}, {free(f"least({to_user})")}),
         least({step('s3', '3', 'D')}, {free(f"least(case when x = 'a' then {kept('s2')} end, {given('s2')})")})
  from ({both}) b join (select *, case when fault = 3 then 1 else 0 end as late from rows) r
    on r.conv_id is not distinct from b.conv_id and r.i = b.i + 1),
ends as (
  select conv_id, least(s0, s3, {step('s2', '2', 'I')}, {step('(' + step('s1', '2', 'I') + ')', '2', 'I')}) as e from best
  qualify i = max(i) over (partition by conv_id)),
letters as (
  select conv_id, unnest(string_split(e[11:], '')) as edit, generate_subscripts(string_split(e[11:], ''), 1) as pos from ends where e[11:] <> ''),
counted as (
  select *, count(*) filter (where edit <> 'I') over w as i, count(*) filter (where edit <> 'D') over w as n
  from letters window w as (partition by conv_id order by pos)),
joined as (
  select l.conv_id, l.pos, l.edit, l.n, r.role, r.text, r.x,
         max(case when l.edit = 'K' and l.n = 1 and r.x = 's' then 1 else 0 end) over (partition by l.conv_id) as system
  from counted l left join rows r on r.conv_id is not distinct from l.conv_id and r.i = l.i and l.edit <> 'I'),
texts as (
  select conv_id, string_agg(case when edit = 'K' then role when (n - system) % 2 = 1 then 'user' else 'assistant' end
                             || ':' || coalesce(text, ''), chr(10) order by pos) filter (where edit <> 'D') as t from joined group by conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank,
         count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated,
         count(*) filter (where wrong) as illegal from rows group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cast(e[:10] as bigint), 0) as cost,
       coalesce(e[11:], '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counts k on k.conv_id is not distinct from c.conv_id
left join ends on ends.conv_id is not distinct from c.conv_id
left join texts on texts.conv_id is not distinct from c.conv_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_warc_packages": op8_warc_packages,
    "op9_quality_rules": op9_quality_rules,
    "op10_source_mixing": op10_source_mixing,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_suffix_tree_scores": op12_suffix_tree_scores,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_repeated_passages": OP6_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op11_centroid_clusters": _op11_sql(),
    "op13_conversation_repair": _op13_sql(),
}
