"""A large group is cut into blocks after its sets and texts were joined to it, so no join holds a member once for each block."""

from covey.llm import op2_ngram_jaccard as op2


def test_blocks_are_dealt_after_the_joins(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = [(k, " ".join([*words[: 59 - k % 2], f"x{k}"])) for k in range(30)] + [(100, "nothing like the others at all")]
    seen, whole = {}, op2._in_blocks
    monkeypatch.setattr(op2, "TEXT_BLOCK", 4)
    monkeypatch.setattr(op2, "SHARD_BLOCK", 5)
    monkeypatch.setattr(op2, "_in_blocks", lambda members, count, block: seen.update({block: members.columns}) or whole(members, count, block))
    found = {r.doc_id: r.component_id for r in op2.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, (80, 100)).collect()}
    assert found == {**dict.fromkeys(range(30), 0), 100: 100}
    assert "point" in seen[5] and "text" in seen[4]
