"""Queries over small tables whose rows tell rules apart."""

from pyspark.sql import functions as F

from vakanz.operators import pages
from vakanz.plans import load


def _pages(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_targets_are_numbered_in_name_order(spark, tmp_path):
    """Two of any three hosts in name order are targets, however their names hash."""
    from vakanz.plans.page_queries import targets

    hosts = [f"h{i:02d}.example" for i in range(30)]
    d = _pages(spark, tmp_path, [(i, f"https://{'www.' if i % 2 else 'm.'}{h}/x", "") for i, h in enumerate(hosts)])
    got = {r.target_label: r.target_pos for r in targets(spark, d).collect()}
    assert got == {h: i for i, h in enumerate(hosts, 1) if i % 3}
    for name, count in (("host_suffix_join", 20), ("page_to_posting", 20), ("target_run_status", 20)):
        assert load().QUERIES[name](spark, d).count() == count


def test_signal_at_the_end_of_a_title(spark):
    """The title is followed by blanks and the text, so a term can start in one and end in the other."""
    def evidence(html, groups):
        row = {"url": "https://firma.example/x", "html": html, "target_url": "https://firma.example/",
               "target_kind": "company_site", "target_label": "Firma"}
        df = pages.page_facts(spark.createDataFrame([row]), signal_groups=groups)
        return pages.page_to_posting(df, signal_groups=groups).first().evidence

    assert evidence("<title>Frau und</title>", ((" und ",), ("the ",))) == ["content_signals:1"]
    assert evidence("x <title>Frau und</title>", (("und  x ",), (" y",))) == ["content_signals:1"]
    assert evidence("<title>Frau Hund</title>", ((" und ",),)) == []


def test_crawl_targets_of_one_address(spark, tmp_path):
    """Addresses of a source that differ in query, fragment or a last slash only are one target."""
    rows = [(0, "https://a.example/x?page=2", ""), (18, "https://A.example/x/", ""), (36, "https://a.example/x#top", ""),
            (54, "https://a.example/y?ref=1", "")]
    got = load().QUERIES["crawl_targets"](spark, _pages(spark, tmp_path, rows)).collect()
    assert sorted((r.source_id, r.target_pos) for r in got) == [(0, 0), (0, 3)]


def test_contact_phone_after_a_cut_number(spark, tmp_path):
    """What follows a number of too many digits starts behind a character of its own, as in the SQL."""
    texts = ["a +1 (543) 555-9258 59.207.203.63 4349000490986231 b", "Tel. +1 (543) 555-9258", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = load().QUERIES["contact_phones"](spark, str(tmp_path)).orderBy(F.col("doc_id")).collect()
    assert [r.phone for r in got] == ["63 4349000490986", "+1 (543) 555-9258", None]
