from loreloom.llm import preferences as P

SCHEMA = "pair_id long, idx int, role string, text string"


def test_prefix_is_rendered_once_and_replies_count(spark):
    chosen = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "good <|end|>"), (1, 3, "user", "more"), (1, 4, "assistant", "é"), (2, 0, "user", "same"), (3, 0, "user", "only chosen")]
    rejected = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "bad"), (2, 0, "user", "same"), (4, 0, "assistant", "only rejected")]
    got = {r.pair_id: r for r in P.format_pairs(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA)).collect()}
    one = got[1]
    assert (one.n_prompt_turns, one.prompt) == (2, "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n")
    assert one.rejected == "<|assistant|>\nbad<|end|>\n"
    spans = [one.chosen[slice(*map(int, s.split("-")))] for s in one.chosen_mask.split(",")]
    assert spans == ["good <\\|end|><|end|>\n", "é<|end|>\n"]
    assert [one.rejected[slice(*map(int, s.split("-")))] for s in one.rejected_mask.split(",")] == ["bad<|end|>\n"]
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", "")
    assert (got[3].n_prompt_turns, got[3].prompt, got[3].rejected) == (0, "", "") and got[3].chosen_mask == ""
    assert got[4].chosen == "" and got[4].rejected_mask == "14-35"


def test_conversations_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, 2, "user", "tail"), (3, 0, None, None), (3, 1, "assistant", None), (4, 0, "user", "no partner"), (None, 0, "user", "x"), (7, 0, "assistant", "y")]
    turns = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, idx int, prompt string")
    got = {r.conv_id: r for r in P.report(turns).collect()}
    assert set(got) == {2, 3}
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == ("<|user|>\nq<|end|>\n", "<|assistant|>\na<|end|>\n", "<|assistant|>\n<|end|>\n")
    assert got[3].prompt == "<|unknown|>\n<|end|>\n"
    assert P.report(turns.limit(0)).count() == 0
    long = spark.createDataFrame([(0, i, "user" if i % 2 == 0 else "assistant", "t" * 1000) for i in range(2000)] + [(1, 0, "assistant", "u")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.n_prompt_turns for r in P.report(long).collect()} == {0: 1999, 1: 0}
