"""Every stage of the pipeline against a plain version of its decision, on its own input."""

import re

import corpus_pipeline as pipeline
import pytest
from conftest import SF
from test_near_copies import kept as plain_kept

from tessera.llm import quality

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        assert (docs.columns == columns) == (k < 4)
        if k == 0:
            model = quality.fit(spark.createDataFrame(before), spark.read.parquet(f"{SF}/labels.parquet"))
            scores = model.score([r.text for r in before])
            assert {r.doc_id for r in after} == {r.doc_id for r, s in zip(before, scores, strict=True) if s >= 0.5}
        elif k == 1:
            assert {r.doc_id for r in after} == plain_kept([(r.doc_id, r.text) for r in before])
        elif k == 2:
            first, words = {}, {r.doc_id: SPLIT.findall(r.text or "") for r in before}
            for i, w in sorted(words.items()):
                for p in range(len(w) - 49):
                    first.setdefault(tuple(w[p : p + 50]), i)
            kept = {}
            for i, w in words.items():
                gone = {j for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for j in range(p, p + 50)}
                kept[i] = [x for j, x in enumerate(w) if j not in gone]
            assert {r.doc_id: SPLIT.findall(r.text or "") for r in after} == {i: w for i, w in kept.items() if w or not words[i]}
        elif k == 3:
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
            size = lambda rows, of: sum(len(SPLIT.findall(r.text or "")) for r in rows if r.source == of)
            sources = sorted({r.source for r in before}, key=lambda x: (x is None, x))
            weight, target = {x: k % 3 + 1 for k, x in enumerate(sources)}, {}
            while True:
                left = sum(size(before, x) for x in sources) - sum(target.values())
                level = left / sum(weight[x] for x in sources if x not in target)
                held = {x: 3 * size(before, x) for x in sources if x not in target and level * weight[x] > 3 * size(before, x)}
                if not held:
                    break
                target |= held
            longest = {x: max(len(SPLIT.findall(r.text or "")) for r in before if r.source == x) for x in sources}
            assert all(abs(size(after, x) - target.get(x, level * weight[x])) <= longest[x] / 2 + 1 for x in sources)
            assert max(sum(r.doc_id == i for r in after) for i in {r.doc_id for r in before}) <= 3
            assert [r.doc_id for r in after] != sorted(r.doc_id for r in after)
        else:
            assert sorted(r.length for r in after) == sorted(len(SPLIT.findall(r.text or "")) for r in before)
        before = after


LONG = " ".join(f"w{k * k % 997}" for k in range(400))
ODD = [
    (1, LONG, "en", "a"), (1, LONG, "en", "a"), (2, LONG, None, None), (3, LONG + " end", "en", "b"), (3, "another text under the same id", "en", "b"),
    (None, LONG, "en", "a"), (None, "a text that stands alone and has no id", "en", "a"), (None, "a text that stands alone and has no id", "en", None),
    (4, None, "en", "a"), (5, "", "de", "a"), (6, " \t\n", "de", None), (7, "one", "de", "c"), (8, "in " * 30_000, "fr", "c"), (9, " ".join(f"x{k}" for k in range(60)) + " " + LONG, "fr", "c"),
]
NAMES = "quality_score Kept_text row text_key key length batch mix_size mix_key mix_words mix_row d_row k_row k_doc component_id fp fp_group source_size k1 k2 doc s_doc n_words held n fp1 sim wide"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, len(t or ""), *range(len(NAMES.split()))) for i, t, lang, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES.split()))


def test_stages_on_odd_rows(spark, odd):
    for k, (_, stage) in enumerate(pipeline.STAGES):
        found = stage(spark, odd, SF)
        assert stage(spark, odd.where("false"), SF).count() == 0
        if k == 4:
            assert found.count() == len(ODD)
            continue
        assert found.schema.simpleString() == odd.schema.simpleString()
        rows = found.collect()
        assert all(tuple(r)[5:] == tuple(range(len(NAMES.split()))) for r in rows)
        if k == 0:
            assert {(r.doc_id, r.text) for r in rows} <= {(i, t) for i, t, *_ in ODD}
        elif k == 1:
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == [-1, 1, 3, 4, 7, 8]
        elif k == 2:
            assert {r.doc_id: r.text for r in rows if r.doc_id in (1, 4, 5, 7)} == {1: LONG, 4: None, 5: "", 7: "one"}
            assert 2 not in {r.doc_id for r in rows} and sum(r.doc_id is None for r in rows) == 3 and sum(r.doc_id == 1 for r in rows) == 2
        else:
            assert {(r.doc_id, r.text) for r in rows} <= {(i, t) for i, t, *_ in ODD if SPLIT.findall(t or "")}
