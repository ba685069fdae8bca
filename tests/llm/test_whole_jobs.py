"""Registered text queries against plain versions: nothing of the job is left out."""

import numpy as np
import pytest

from caseloom.llm import chat_format, queries
from tests.llm import brute


def test_scores_weigh_two_words_of_context(spark, tmp_path):
    rng = np.random.default_rng(7)
    weights = [0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05]
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 12)), p=weights))) for i in range(120)]
    rows.append((200, None))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "held_out", "train_tokens", "score"]
    got = {r[0]: tuple(r)[1:] for r in queries.op4_lm_scoring(spark, str(tmp_path)).select(*names).collect()}
    train = [t for d, t in rows if not brute.held_out(d)]
    assert 0 < len(train) < len(rows) and len(got) == len(rows)
    model = brute.KneserNey(train, 3)
    for d, t in rows:
        assert got[d][:2] == (brute.held_out(d), sum(len((t or "").split()) + 1 for t in train))
        assert got[d][2] == pytest.approx(model.score(t))


@pytest.mark.parametrize("step", [1, 1000])
def test_windows_repeat_history_across_stretches(spark, step):
    said = {k: f"turn {k} " + "x " * (k % 7) for k in range(600)}
    rows = [(c, k * step, "user", said[k]) for c in (1, None) for k in range(600)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for tokenizer in (None, queries.TOKENIZER):
        if tokenizer is None:
            size = {said[k]: len(said[k].split()) + 4 for k in said}
        else:
            from caseloom.llm.token_counts import Counter, Viterbi, read_pieces

            size = dict(zip(said.values(), [n + 4 for n in Counter(Viterbi(read_pieces(tokenizer))).count(list(said.values()))[0]]))
        windows = chat_format.format_chats(table, tokenizer=tokenizer).collect()
        for conv in (1, None):
            seen = []
            for w in sorted((w for w in windows if w["conv_id"] == conv), key=lambda w: (w["stretch"], w["window"])):
                texts = [t for _, t, _, _ in chat_format.read_turns(w["formatted"])]
                repeated, total = 0, 0
                while repeated < len(seen) and total + size[seen[-1 - repeated]] <= chat_format.HISTORY:
                    total += size[seen[-1 - repeated]]
                    repeated += 1
                assert w["n_repeated"] == repeated
                assert texts[:repeated] == seen[len(seen) - repeated :]
                assert w["n_tokens"] == sum(size[t] for t in texts) <= chat_format.BUDGET
                seen += texts[repeated:]
            assert seen == list(said.values())
            assert {w["stretch"] for w in windows} == {0, 1, 2}


def test_long_lines_that_cannot_match_are_told_by_their_signatures(spark):
    from caseloom.llm import line_dedup

    base = [f"w{i}" for i in range(300)]
    lines = [base, base[:-30] + [f"x{i}" for i in range(30)], ["w0", *[f"y{i}" for i in range(299)]]]
    texts = spark.createDataFrame([(1, k, words) for k, words in enumerate(lines)], "doc long, line int, words array<string>")
    pairs = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 1, 0), (1, 2, 1, 1)], "doc long, line int, doc0 long, line0 int")
    assert [tuple(r) for r in line_dedup._close(pairs, texts, 80).collect()] == [(1, 1, 1, 0)]
    docs = spark.createDataFrame([(1, "\n".join(" ".join(x) for x in lines))], "doc_id long, text string")
    kept = line_dedup.dedup_lines(docs).first()
    assert kept["n_removed_lines"] == 1 and kept["text"] == "\n".join(" ".join(lines[k]) for k in (0, 2))
