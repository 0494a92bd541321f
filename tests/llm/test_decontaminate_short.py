from lexstrata.llm import decontaminate


def test_short_items_and_further_texts(spark):
    long = "which of the seven rivers of the north country reaches the sea last"
    texts = ["So: The Cat sat!", "the catalog sat", None, f"x {long} y", "see answer forty-two.", "我们住在东京都里", "who wrote the small bluw book? me", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(1, "the cat"), (2, long), (2, "answer forty two"), (3, "东京都"), (4, "who wrote the small blue book"), (5, "  "), (6, "cat")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: list(zip(r.item_ids, r.distances)) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {0: [(1, 0), (6, 0)], 1: [], 2: [], 3: [(2, 0)], 4: [(2, 0)], 5: [(3, 0)], 6: [(4, 1)], 7: []}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [1, 2, 7]
