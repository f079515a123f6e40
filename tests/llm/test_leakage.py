import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import with_extra
from millrace.llm.leakage import WuManber, best_chain, leaked_items, plain, words

PASSAGE = "Nobody may compare a schema while the shared bundle aligns the probe; a ranker that was published across any planner will traverse the manifest, isn't it so?"


def brute(table_items, text, run):
    found = {}
    for key, own in table_items:
        hits = [(i, j) for i in range(len(text) - run + 1) for j in range(len(own) - run + 1) if text[i : i + run] == own[j : j + run]]
        if hits:
            found[key] = hits
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=3, max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=40))
def test_search_finds_what_comparison_finds(items, text):
    numbered = list(enumerate(items))
    got = {k: sorted(v) for k, v in WuManber(numbered, 3).occurrences(text).items()}
    assert got == {k: sorted(v) for k, v in brute(numbered, text, 3).items()}


DRESSES = [
    PASSAGE,
    PASSAGE.upper(),
    PASSAGE.replace("schema", "sch­ema").replace("bundle", "bun​dle"),
    PASSAGE.replace(" the ", " <em>the</em> ").replace(" ", "&nbsp;", 3),
    PASSAGE.replace("isn't", "isn’t").replace("ranker", "**ranker**"),
    "\n".join("// " + PASSAGE[i : i + 40] for i in range(0, len(PASSAGE), 40)).replace("// \n", ""),
    "Nobody may com-\n> pare a schema while the shared bun-\n> dle aligns the probe; a ranker that was published across any planner will traverse the manifest",
    '{"q": "' + PASSAGE.replace(" the ", "\\nthe ") + '"}',
    "before " + " ".join(PASSAGE.split()[:16]) + " after",
]


@pytest.mark.parametrize("text", DRESSES)
def test_dresses(text):
    own = words(PASSAGE)
    hits = WuManber([(1, own)]).occurrences(words("Something else first. " + text + " And more."))
    covered, _, _ = best_chain(hits[1], len(own))
    assert covered >= 0.5 * len(own)


def test_runs_must_be_in_order_and_near():
    own = [f"w{i}" for i in range(40)]
    search = lambda text: best_chain(WuManber([(1, own)]).occurrences(text).get(1, []), 40)[0]
    filler = [f"x{i}" for i in range(200)]
    assert search(own[:10] + filler[:5] + own[20:30]) == 20
    assert search(own[:10] + filler + own[20:30]) == 10
    assert search(own[20:30] + own[:10]) == 10
    assert search(own[:5] + ["x"] + own[5:10]) == 0
    assert search(own + own) == 40


def test_table(spark):
    docs = with_extra(spark.createDataFrame([(1, "a " + PASSAGE), (1, "a " + PASSAGE), (2, "nothing"), (3, None), (None, PASSAGE), (4, ""), (5, "word " * 50_000 + PASSAGE)], "doc_id long, text string"), "TEXT", "item_id")
    items = with_extra(spark.createDataFrame([(9, PASSAGE), (9, None), (9, "short"), (8, "too short to count at all"), (None, PASSAGE), (7, "")], "item_id long, passage string"), "doc_id", "ITEM_ID")
    for a_table in (1_000_000, 200):
        got = leaked_items(docs, items, bytes_a_table=a_table).orderBy("doc_id").collect()
        assert [(r.doc_id, r.item_id) for r in got] == [(1, 9), (5, 9)]
        assert got[0].covered_words == got[0].item_words
    assert leaked_items(docs.limit(0), items).count() == 0
    assert leaked_items(docs, items.limit(0)).count() == 0


def test_plain_keeps_other_text():
    assert plain("a < b & c-d \\w") == "a < b & c-d \\w"


def test_tables_are_small():
    import random
    import tracemalloc

    rng = random.Random(4)
    items = [(i, [f"w{rng.randrange(5000)}" for _ in range(80)]) for i in range(400)]
    size = sum(len(" ".join(own)) for _, own in items)
    tracemalloc.start()
    table = WuManber(items)
    took = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert took < 110 * size and len(table.item) == 400 * 75
