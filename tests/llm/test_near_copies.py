"""The near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import corpus_pipeline as pipeline
from conftest import SF

TEXT = [f"w{k * k % 997}" for k in range(400)]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """Smallest doc_id of each component of texts with a similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both * 5 >= (len(sets[i] | sets[j])) * 4:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return {i for i in sets if root(i) == i}


def ids(spark, rows):
    return sorted(r.doc_id for r in pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect())


def test_stage_finds_all_similar_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    top = max(i for i, _ in rows)
    for k in range(40):  # more and more words changed, so similarities lie on both sides of 0.8
        rows.append((top + 1 + k, " ".join("x" if j * 40 < k * 400 / 4 and j % 5 == 0 else w for j, w in enumerate(TEXT))))
    for k in range(60):  # a chain in which neighbours are similar and ends are not, and a passage that many texts share
        rows.append((top + 101 + k, " ".join(f"c{j}" for j in range(3 * k, 3 * k + 50))))
        rows.append((top + 201 + k, " ".join([*TEXT[:40], *(f"p{k}q{j}" for j in range(30))])))
    expected = kept(rows)
    assert ids(spark, rows) == sorted(expected) and top + 201 in expected and top + 102 not in expected


def test_stage_keeps_the_threshold(spark):
    words = [f"t{k}" for k in range(44)]  # 40 shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[:36])), (3, " ".join(["u", *words[:35]])), (4, "a b"), (5, "A  b"), (6, None), (7, " ")]
    assert ids(spark, rows) == sorted(kept(rows)) == [1, 4, 6]
    assert ids(spark, [rows[0], (8, " ".join(words[:35]))]) == [1, 8]


def test_blocks_of_long_lists(spark, monkeypatch):
    """Lists cut into many blocks: pairs across blocks are found all the same."""
    from tessera.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", 4)
    head = [f"h{k}" for k in range(30)]
    rows = [(k, " ".join([*head, *(f"g{k % 7}t{j}" for j in range(6 + k % 5)), f"own{k}"])) for k in range(80)]
    assert ids(spark, rows) == sorted(kept(rows))


def test_fingerprint_groups_are_candidates(spark):
    from tessera.llm import near_copies

    docs = spark.createDataFrame([(1, " ".join(TEXT)), (2, " ".join([*TEXT, "end"])), (3, "a b c")], "doc_id long, text string")
    heads = near_copies.points(docs, near_copies.common_shingles(docs))
    assert near_copies._tight(heads).count() == 1


def test_candidates_grow_with_texts_not_pairs(spark, monkeypatch):
    """Groups whose members lie just under the threshold, and chains of similar ones, make few candidate pairs a text."""
    import random

    from tessera.llm import near_copies

    made, similar = [], near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, *more: made.append(pairs.count()) or similar(pairs, *more))
    rng, rows = random.Random(5), []
    for group in range(2):
        words = [f"g{group}w{k}" for k in range(400)]
        for k in range(60):
            changed = set(rng.sample(range(0, 400, 7), 5 if group else 2 + k % 5))
            rows.append((len(rows), " ".join(f"x{k}y{j}" if j in changed else w for j, w in enumerate(words))))
    assert ids(spark, rows) == sorted(kept(rows))
    assert sum(made) <= 4 * len(rows)
