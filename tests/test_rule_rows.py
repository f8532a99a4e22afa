"""Rule rows are made of the schemes, not of all their pairs with profiles."""

from eligo.registry import REGISTRY, matching
from eligo.registry.common import Tables


def test_rule_rows_read_no_links(spark, monkeypatch):
    read, cut = [], matching.cut_lineage

    def watched(df, name):
        read.extend(df.inputFiles())
        return cut(df, name)

    monkeypatch.setattr(matching, "cut_lineage", watched)
    t = Tables(spark, "/root/testdata/sf0.001")
    rows, built = (REGISTRY.queries[q](t) for q in ("g21_rule_rows", "g21_stored_rules"))
    assert read and {f.split("/")[-1] for f in read} == {"part.parquet"}
    assert rows.exceptAll(built).isEmpty() and built.exceptAll(rows).isEmpty()
