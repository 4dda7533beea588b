"""Near-duplicates of all records against brute force."""

from __future__ import annotations

import random

from tapeline.plans.evidence import near_duplicates


def _score(a, b):
    x, y = (set(" ".join((t or "").split()).lower().split(" ")) for t in (a[2], b[2]))
    title = len(x & y) / len(x | y)
    if a[3] is None or b[3] is None:
        return title
    p, q = (" ".join(t.split()).lower()[:256] for t in (a[3], b[3]))
    same = next((i for i, (m, n) in enumerate(zip(p, q)) if m != n), min(len(p), len(q)))
    return (title + (same / min(len(p), len(q)) if p and q else 0.0)) / 2


def test_near_duplicates_of_any_source_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(150):
        title, content = " ".join(word() for _ in range(14)), " ".join(word() for _ in range(rng.choice((1, 3, 30, 60))))
        if rows and rng.random() < 0.7:
            _, _, title, content = rng.choice(rows)
            parts = (title or "").split(" ")
            if rng.random() < 0.4:
                parts[rng.randrange(len(parts))] = word()
            title = " ".join(parts)
            if content and rng.random() < 0.5:
                at = rng.randrange(len(content))
                content = content[:at] + rng.choice("xyz") + content[at + 1 :]
        content = rng.choice((content, content, content, content, None, "  "))
        rows.append((f"e{i:03d}", f"s{i % 7}", rng.choice((title, title, title, title.upper(), f" {title} ")), content))
    rows += [("z1", "s", None, None), ("z2", "s", " ", None), ("z3", "t", "", "text"), ("z4", "t", "", "text")]
    want = {}
    for a in rows:
        scores = [s for b in rows if b is not a and (s := _score(a, b)) >= 0.92]
        want[a[0]] = (len(scores), round(max(scores), 4) if scores else None, "near_duplicate" if scores else "distinct")
    frame = spark.createDataFrame(rows, "evidence_id string, source_id string, title string, content string").repartition(5)
    out = near_duplicates(frame).collect()
    assert len(out) == len(rows) and {r.evidence_id: (r.links, r.score, r.decision) for r in out} == want
    assert sum(n > 0 for n, *_ in want.values()) > 40 and near_duplicates(frame.where("1 = 0")).count() == 0
