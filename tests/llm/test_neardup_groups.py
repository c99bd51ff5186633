"""Large groups of near copies: the work grows with the texts, not with their pairs."""

import random

from reeltide.llm import neardup


def test_pairs_of_a_group_of_near_copies_grow_with_its_texts(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(500):  # no two of them need be alike by 0.9; with the text they were made from all are
        text = list(base)
        for at in rng.sample(range(150), 8 if i else 0):
            text[at] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(text)))
    seen, verify = [], neardup._verify

    def counted(pairs, numbers):
        seen.append(pairs.count())
        return verify(pairs, numbers)

    monkeypatch.setattr(neardup, "_verify", counted)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(501, 500)}
    assert sum(seen) < 2 * len(rows), seen
