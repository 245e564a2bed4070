"""Passages that neither the first holder of their runs nor the one before has."""

import random

from tessera.llm import substring_dedup


def test_a_holder_between_is_found(spark):
    r = random.Random(3)
    new = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    rows, want = [], {}
    for case in range(6):
        passage, base = new(50), 10 * case
        part = lambda cut: " ".join(new(30) + cut + new(30))  # noqa: B023, E731
        # All runs of the passage are in texts that have 49 of its words, before and behind the source.
        for i, cut in enumerate([passage[:49], passage[1:], passage, passage[:49], passage[1:], passage[:49], passage[1:]]):
            rows.append((base + i, part(cut)))
        head = new(40 + case)
        # A further copy behind others, twice in its text.
        rows.append((base + 7, " ".join([*head, *passage, *new(30), *passage, *new(9)])))
        want[base + 7] = (base + 2, len(head), passage)
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    text, found = dict(rows), {}
    for row in got.collect():
        found.setdefault(row["doc_id"], []).append(row)
    assert set(found) == set(want)
    for doc, (source, _, passage) in want.items():
        assert [(p["source_id"], text[doc][p["begin"] : p["stop"]]) for p in sorted(found[doc], key=lambda p: p["begin"])] == [(source, " ".join(passage))] * 2
