from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from driftpanel.llm import decontaminate


def words_of(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def brute(docs, items):
    """(doc, item) pairs with an aligned run of 18 words (or the whole item) that differs in few words."""
    out = {}
    for d, text in docs:
        x = words_of(text)
        for i, item in items:
            y = words_of(item)
            run = min(18, len(y))
            if len(y) < 8:
                continue
            allowed = 3 if run >= 18 else 2 if run >= 14 else 1 if run >= 9 else 0
            for a in range(len(x) - run + 1):
                for b in range(len(y) - run + 1):
                    equal = sum(p == q for p, q in zip(x[a : a + run], y[b : b + run], strict=True))
                    if equal >= run - allowed:
                        out[d, i] = max(out.get((d, i), 0), equal)
    return out


@pytest.mark.parametrize(("run", "wrong"), [(9, 1), (14, 2), (18, 3), (8, 0)])
def test_masks_lose_no_tolerated_substitution(run, wrong):
    for bad in combinations(range(run), wrong):
        assert any(all(s + o not in bad for o in m) for m in decontaminate.MASKS for s in range(run - m[-1]))


def cases(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [" ".join(rng.choices(vocabulary, k=k)) for k in (8, 9, 12, 14, 17, 18, 25, 40, 90, 7, 3)]
    docs = []
    for item in items:
        for wrong in range(6):
            words = item.split()
            for at in rng.sample(range(len(words)), min(wrong, len(words))):
                words[at] = "changed"
            own = [rng.choices(vocabulary, k=rng.randrange(0, 30)) for _ in range(2)]
            docs.append(", ".join(own[0] + words + own[1]).upper())
    docs += [" ".join(rng.choices(vocabulary, k=200)) for _ in range(10)] + ["", None, "x", "ha " * 300, " ".join(items[7].split()[5:30])]
    return list(enumerate(docs)), [*enumerate(items), (20, None), (21, ""), (22, "ha " * 30)]


def test_equals_brute_force(spark, documents):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(documents(*[t for _, t in docs], extra="seed int, words string", values=(1, "x")), bench)
    found = {}
    for r in got.collect():
        found[r.doc_id, r.item_id] = max(found.get((r.doc_id, r.item_id), 0), r.equal)
    assert found == brute(docs, items)


def test_copies_of_an_item_count_under_the_smallest_id(spark, documents):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(4, item), (2, item.upper()), (3, item + "!"), (9, "other " * 9)], "item_id long, text string")
    docs = documents(f"intro {item} end", "nothing here", (7, item, None, None, None), (7, "same id", None, None, None), (None, item, None, None, None))
    got = sorted((str(r.doc_id), r.contaminated, r.n_items, r.first_item, r.most_equal) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [("0", True, 3, 2, 18), ("7", True, 3, 2, 18), ("None", True, 3, 2, 18)]


def test_shuffle_join_beyond_the_broadcast_bound(spark, documents, monkeypatch):
    docs, items = cases(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.contaminated(documents(*[t for _, t in docs]), bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert sorted(map(tuple, decontaminate.contaminated(documents(*[t for _, t in docs]), bench).collect())) == want


def test_clean_documents_stay_with_all_columns(spark, documents):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    docs = documents(item, "clean words", None, "", (None, "clean", None, None, None), extra="item_id int", values=(3,))
    kept = decontaminate.without_benchmark(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]
    assert decontaminate.without_benchmark(docs, bench.limit(0)).count() == 5
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
