"""A positional trigram index over text columns, and keyword search with queries as a table.

Texts that are equal, of whatever row and column, are one text of the index; the rows that hold it are filed apart and met by
the texts found. Every place of a text has a trigram, the last two filled up with END, so that shorter texts and ends are found
too. A posting is a trigram, a text and all places there.

A query text is a case-free pattern: % and _ are wildcards, what lies between them are its runs. The two rarest trigrams of
the run that has the rarest one are looked up by an equi-join; where both lie at the distance they have in the run, the text
is a candidate, and only candidates are compared with the pattern. A query that has a trigram the index does not know
matches nothing and reads no posting. Runs of one or two characters are looked up by all trigrams that begin with them.
Patterns of wildcards alone match every row with a long enough text. Null and blank texts ask for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
END = "\u0000"
ESCAPE = "\u0001"  # of patterns: a character that texts do not hold, so that none escapes
FIELDS = ("name", "description", "ministry", "scheme_code")


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _grams(text: Column, last: Column) -> Column:
    """(at, tri) of the places 1 to ``last``."""
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(i.alias("at"), F.substring(text, i, F.lit(3)).alias("tri")))


def build(rows: DataFrame, path: str, fields=FIELDS, key: str = "id") -> Index:
    """Files texts, their rows, postings and the number of postings of each trigram under ``path``."""
    index = Index(rows.sparkSession, path)
    held = rows.select(c(key).cast("string").alias("id"), F.explode(F.array_distinct(F.array(*[F.lower(c(f)) for f in fields]))).alias("low"))
    held = held.where(F.length("low") > 0).withColumn("text", F.sha2("low", 256))
    held.select("text", "id").write.mode("overwrite").parquet(f"{path}/rows")
    held.groupBy("text").agg(F.first("low").alias("low")).write.mode("overwrite").parquet(f"{path}/texts")
    padded = F.concat("low", F.lit(END * 2))
    places = index.table("texts").select("text", F.explode(_grams(padded, F.length("low"))).alias("g"))
    # the places of a text's trigram meet in its own task: a common trigram is no hot key here
    postings = places.groupBy("text", c("g.tri").alias("tri")).agg(F.sort_array(F.collect_list("g.at")).alias("places"))
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    index.table("postings").groupBy("tri").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
    return index


def patterns(queries: DataFrame) -> DataFrame:
    """query_id and low: the case-free pattern text of queries (query_id, text) that ask for something."""
    low = F.lower(F.regexp_replace(c("text"), r"^\s+|\s+$", ""))
    return queries.select(c("query_id").cast("string").alias("query_id"), low.alias("low")).where(F.length("low") > 0)


def _picks(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """query_id, tri, at and need: the one or two trigrams that a query is looked up by, or all that begin with its run."""
    runs = asked.select("query_id", F.posexplode(F.split("low", "[%_]", -1)).alias("run", "t")).where(F.length("t") > 0)
    size = F.length("t")
    grams = runs.where(size >= 3).select("query_id", "run", F.explode(_grams(c("t"), size - 2)).alias("g")).select("query_id", "run", "g.*")
    known = grams.join(counts, "tri", "left").groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run", "at", "tri"))).alias("g"))
    known = known.where(c("g")[0]["n"] > 0).withColumn("first", c("g")[0])
    second = F.filter("g", lambda x: (x["run"] == c("first.run")) & (x["at"] != c("first.at")))
    long_ = known.select("query_id", F.concat(F.array("first"), F.slice(second, 1, 1)).alias("p")).select(
        "query_id", F.size("p").alias("need"), F.explode("p").alias("x")).select("query_id", "x.tri", "x.at", "need")
    whole = F.max_by("t", F.struct(size.alias("size"), "run"))
    short = runs.groupBy("query_id").agg(whole.alias("t")).where(size < 3)
    begins = counts.select("tri", F.explode(F.array(F.struct(F.left("tri", F.lit(1)).alias("t")), F.struct(F.left("tri", F.lit(2)).alias("t")))).alias("b"))
    begins = begins.select("tri", "b.t").distinct()
    return long_.unionByName(short.join(begins, "t").select("query_id", "tri", F.lit(1).alias("at"), F.lit(1).alias("need")))


def matches(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, id), once each, of all rows that have a text with the query's pattern in it."""
    asked = patterns(queries)
    picks = _picks(asked, index.table("counts"))
    met = picks.join(index.table("postings"), "tri").select("query_id", "need", "text", "at", F.explode("places").alias("place"))
    together = met.groupBy("query_id", "text", (c("place") - c("at")).alias("start")).agg(
        F.count_distinct("at").alias("n"), F.first("need").alias("need")).where("n = need")
    candidates = together.select("query_id", "text").distinct()
    texts = index.table("texts")
    compared = candidates.join(texts, "text").join(asked.withColumnRenamed("low", "pattern"), "query_id")
    found = compared.where(F.expr(f"low like concat('%', pattern, '%') escape '{ESCAPE}'")).select("query_id", "text")
    # patterns without a run: by the length they ask for, each text goes to those it is long enough for
    bare = asked.where(F.length(F.regexp_replace("low", "[%_]", "")) == 0).select(
        "query_id", F.length(F.replace("low", F.lit("%"), F.lit(""))).alias("least"))
    sizes = bare.agg(F.sort_array(F.collect_set("least")).alias("s"))
    enough = texts.select("text", F.length("low").alias("size")).withColumn("s", sizes.scalar()).select(
        "text", "size", F.explode("s").alias("least")).where("least <= size")
    every = found.unionByName(bare.join(enough, "least").select("query_id", "text"))
    return every.join(index.table("rows"), "text").select("query_id", "id").distinct()
