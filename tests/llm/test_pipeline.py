"""The pipeline, stage by stage, against plain versions on a small corpus."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import common  # noqa: E402
import corpus_pipeline  # noqa: E402

from textquarry.session import cut_lineage  # noqa: E402


def corpus(spark):
    rows = [(d, t, "en", f"src{(d or 0) % 4}", len(t or "")) for d, t in common.corpus(4)]
    rows += [(None, "the of and the of and is", None, None, None), (2000, None, "en", "src1", 0), (2001, "  ", "en", "src1", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    docs = cut_lineage(corpus(spark))
    stages = dict(corpus_pipeline.STAGES)
    kept = cut_lineage(stages["language_id"](spark, docs, ""))
    given, left = Counter(pairs(docs)), Counter(pairs(kept))
    assert left <= given
    assert all(common.words_of(t) for _, t in left)
    assert not [t[:99] for _, t in (given - left) if common.words_of(t)]

    alone = cut_lineage(stages["near_duplicates"](spark, kept, ""))
    rows = [p for p in pairs(kept) if p[0] is not None]
    least = common.classes(rows)
    assert Counter(p for p in pairs(alone) if p[0] is not None) == Counter({p for p in rows if least[p[0]] == p[0]})

    cut = cut_lineage(stages["substring_dedup"](spark, alone, ""))
    rows = pairs(alone)
    expected = common.without_repeats(rows)
    texts = [(d, t if expected[d, t][1] == 0 else expected[d, t][2]) for d, t in rows if expected[d, t][1] == 0 or expected[d, t][2]]
    assert Counter(pairs(cut)) == Counter(texts)

    mixed = cut_lineage(stages["source_mix"](spark, cut, ""))
    words = {d: Counter(common.words_of(t)) for d, t in pairs(cut)}
    taken = Counter()
    for d, t in pairs(mixed):
        own = Counter(common.words_of(t))
        assert own and own <= words[d]
        taken[d] += sum(own.values())
    assert all(n <= 3 * sum(words[d].values()) for d, n in taken.items())
    assert mixed.columns == cut.columns == alone.columns == kept.columns == list(corpus_pipeline.COLUMNS)

    packed = stages["packing"](spark, mixed, "").collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(d for d, _ in pairs(mixed))


def test_empty_table_passes_through(spark):
    docs = corpus(spark).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, ""))
    assert docs.count() == 0


def test_mix_stage_stays_in_the_engine(spark):
    plan = dict(corpus_pipeline.STAGES)["source_mix"](spark, cut_lineage(corpus(spark)), "")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near_copies_go_by_row_and_not_by_id(spark):
    rng = common.random.Random(8)
    base, own = common.prose(rng, 60), common.prose(rng, 60)
    near = base + " more"
    rows = [(1, base), (2, near), (2, own), (3, near + " x"), (None, base + " y"), (4, own + " z"), (5, "few words"), (5, "few words"), (6, None), (6, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, cut_lineage(docs.repartition(3)), "")
    assert Counter(pairs(kept)) == Counter([(1, base), (2, own), (5, "few words"), (6, None)])
