import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import prose
from vakanz.llm import quality_model, queries, toxicity
from vakanz.llm.labelled import fold_of, labelled_rows

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    y = np.asarray(labels)
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / n / (len(y) - n)


def held_out(spark, query, label):
    rows = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert ((rows["score"] >= 0) & (rows["score"] <= 1)).all() and (rows["predicted"] == (rows["score"] >= 0.7)).all()
    rows = rows[rows["held_out"]]
    return auc(rows["score"].to_numpy(), rows[label].to_numpy())


def test_quality_on_held_out_rows(spark):
    assert held_out(spark, queries.op2, "quality") > 0.97


@pytest.mark.parametrize(("where", "least", "recall", "wrong"), [
    (SF, 0.65, 0.35, 0.06),  # 33 toxic documents to learn from, 18 to find
    ("/root/testdata/sf0.1", 0.9, 0.62, 0.025)])
def test_toxicity_on_held_out_rows(spark, where, least, recall, wrong):
    labels = spark.read.parquet(f"{where}/labels.parquet")
    rows = queries.op4(spark, where).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL").toPandas()
    assert ((rows["score"] >= 0) & (rows["score"] <= 1)).all() and (rows["predicted"] == (rows["score"] >= 0.7)).all()
    caught = [rows["predicted"][rows["toxic"] == kind].mean() for kind in (0, 1)]
    found = auc(rows["score"].to_numpy(), rows["toxic"].to_numpy())
    print(f"op4 {where}: AUC {found:.3f}, recall {caught[1]:.3f}, false positives {caught[0]:.4f}")
    assert found > least and caught[1] > recall and caught[0] < wrong


def test_toxicity_with_more_to_learn_from(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ta", "re", "no", "li", "su", "en"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(900):
        text = [word() for _ in range(rng.randrange(30, 200))]
        if i % 3 == 0:
            for _ in range(len(text) // 25 + 1):
                text[rng.randrange(len(text))] = rng.choice(["wretchling", "dunderclod", "gruntmuck"])
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.score_toxicity(docs, docs.filter("doc_id < 600")).toPandas().set_index("doc_id")["score"]
    assert auc(scored.loc[600:].to_numpy(), [r[2] for r in rows[600:]]) > 0.97


def test_toxicity_sample_is_spread_over_the_table(spark, caplog):
    """Texts above the byte bound leave no kind, source or text out of the sample."""
    rows, seeds = [], random.Random(5).sample(range(10_000), 500)  # the words around have nothing to do with the kind
    for i in range(400):
        text = prose(seeds[i], 40)
        if i % 4 == 0:
            text += " wretchling" if i < 200 else " dunderclod"
        rows.append((i, text, int(i % 4 == 0)))
    rows[0] = (0, prose(0, 9_000) + " wretchling", 1)  # the first toxic text alone is above the bound
    rows[1] = (1, prose(1, 9_000), 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").coalesce(1)
    fresh = spark.createDataFrame([(1_000 + i, prose(seeds[400 + i], 50) + (" dunderclod" if i % 2 else ""), i % 2) for i in range(100)],
                                  "doc_id long, text string, toxic int")
    scored = toxicity.score_toxicity(docs.unionByName(fresh), docs, max_bytes=90_000, max_toxic=100, max_ordinary=300)
    scored = scored.filter("doc_id >= 1000").toPandas().sort_values("doc_id")["score"]
    assert auc(scored.to_numpy(), [i % 2 for i in range(100)]) > 0.95
    assert not caplog.records
    toxicity.score_toxicity(docs, docs.filter("toxic = 0"))
    assert "kind toxic" in caplog.text


def test_bounded_texts():
    text = toxicity.plain(" ".join(f"word{i}" for i in range(5_000)))
    cut = toxicity.bounded(text, 4_096, 64)
    assert 3_900 < len(cut) <= 4_096 and all(w in set(text.split()) for w in cut.split())
    places = [text.find(w) for w in toxicity.windows(cut, 64)]
    assert max(places) > len(text) * 0.9 and toxicity.bounded(text, len(text), 64) == text
    assert toxicity.bounded(b" " + b"x" * 9_000 + b" ", 100, 64) == b""
    assert toxicity.water_level([5, 100, 1], 26) == 20 and toxicity.water_level([1, 2], 9) == 2
    assert toxicity.water_level([], 9) == 0 and toxicity.water_level([10, 10, 10], 9) == 3


@pytest.mark.parametrize(("score", "empty"), [(toxicity.score_toxicity, 0.0), (quality_model.score_quality, 0.5)])
def test_odd_rows(spark, odd_docs, odd_rows, no_docs, score, empty):
    label = {"label_col": "y"}
    schema = "doc_id long, y int"
    none = spark.createDataFrame([(1, 1), (2, None)], schema)
    got = score(odd_docs, none, **label).collect()
    assert len(got) == len(odd_rows) and all(r["score"] == empty for r in got)
    some = spark.createDataFrame([(1, 1), (8, 0), (9, 0), (3, 1), (7, 0), (7, 1), (10, 0), (12, 1), (None, 1)], schema)
    got = score(odd_docs, some, **label).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert score(no_docs, some, **label).count() == 0


def test_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, None), (None, 1), (4, 1), (5, 1)], "i long, y int")
    assert sorted(r[0] for r in labelled_rows(labels, "i", "y", 1, 10).collect()) == [1, 4, 5]
    assert labelled_rows(labels, "i", "y", 1, 2).count() == 2
    ids = spark.createDataFrame([(7,), (-3,), (None,)], "i long").select("i", fold_of(F.col("i"), 4).alias("f")).collect()
    assert [r["f"] for r in ids] == [zlib.crc32(b"7") % 4, zlib.crc32(b"-3") % 4, -1]


def test_statistics_and_isotonic_pools():
    assert len(quality_model.statistics(None)) == len(quality_model.FEATURES) == len(quality_model.statistics("a\nb # C"))
    places, rates = quality_model.pooled([(0.1, 10, 1), (0.2, 10, 5), (0.3, 10, 3), (0.4, 20, 20)])
    assert (np.diff(rates) > 0).all() and (np.diff(places) > 0).all() and len(places) == 3
    one = quality_model.Model(np.zeros(18), np.ones(18), np.random.default_rng(1).normal(size=(18, 4000)) / 0.9, np.random.default_rng(2).uniform(0, 6.2832, 4000))
    x = np.random.default_rng(3).normal(size=(30, 18)) * 0.3
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 2 / 0.81)
    z = one.fourier(x)[:, :-1]
    assert np.abs(z @ z.T - kernel).max() < 0.1


def test_windows_and_dictionaries():
    text = toxicity.plain("  Aa  bB\tcc " * 200)
    cuts = toxicity.windows(text, 64)
    assert b"".join(cuts) == text and all(c.endswith(b" ") for c in cuts) and toxicity.windows(b"", 64) == [b""]
    assert toxicity.windows(b" x ", 64) == [b" x "]


def test_pieces_are_ranked_against_noise():
    """One wrong label or quotation in twenty takes no piece out; what both kinds hold is none."""
    toxic = [b" so moronic you %d " % i for i in range(40)] + [b" it is %d " % i for i in range(9)]
    ordinary = [b" so it is you %d " % i for i in range(57)] + [b" so moronic it is "] * 3
    odds = toxicity.log_odds(toxic, ordinary)
    own = toxicity.telling_pieces(toxic, odds, 3.0, 64)
    assert b" moronic " in own and b" you " not in own and len(b"".join(own)) <= 64
    assert toxicity.telling_pieces(toxic, odds, 1e9, 64) == []
    assert toxicity.pieces(b" ab abcdefghijklmno ") == {b" ab ", b" abcdefghijklmno ", *(b" abcdefghijklmno"[:n] for n in range(5, 12))}


def test_pieces_of_toxic_texts_alone_rank_above_those_of_near_copies():
    """Found by the check: words of a group of near copies, in both kinds, had taken the whole dictionary."""
    copied = [b"copied%d" % i for i in range(40)]
    own = [b" ".join((b"text%d" % i, b"lowei" + [b"en", b"ist", b"ach"][i % 3])) for i in range(300)]
    toxic = [b" %s %s " % (t, b" ".join(copied)) if i < 40 else b" %s " % t for i, t in enumerate(own)]
    ordinary = [b" some%d %s " % (i, b" ".join(copied)) if i < 25 else b" some%d " % i for i in range(2_700)]
    odds = toxicity.log_odds(toxic, ordinary)
    found = toxicity.telling_pieces(toxic, odds, 3.0, 64)
    assert found[0] == b" lowei" and all(g.startswith(b" low") or g.startswith(b" text") for g in found[:3])


def test_pieces_that_share_a_cell_are_told_apart(monkeypatch):
    """A rare piece in the cell of a telling one is none."""
    rude, rare = b" idiot ", b" meadow "
    monkeypatch.setattr(toxicity.zlib, "crc32", lambda g, crc=zlib.crc32: crc(rude if g == rare else g))
    toxic = [b" idiot person%d " % i for i in range(60)] + [b" meadow "]
    ordinary = [b" person%d " % i for i in range(300)]
    found = toxicity.telling_pieces(toxic, toxicity.log_odds(toxic, ordinary), 3.0, 64)
    assert rude in found and rare not in found


def test_the_dictionaries_differ_in_their_own_pieces_only():
    ordinary = [toxicity.plain(prose(i, 60)) for i in range(80)]
    toxic = [toxicity.plain(prose(i + 500, 60) + " wretchling") for i in range(40)]
    model = toxicity.train(ordinary, toxic, 64, 4_096, 256, 3.0, 1_000)
    assert b" wretchling" in model.toxic and b"wretchling" not in model.ordinary
    plain, rude = (model.features(f"{prose(900, 30)} {w}")[0] for w in ("", "wretchling"))
    assert rude >= plain + 3
