import duckdb
from pyspark.sql import functions as F

from tabulon.llm import chat, queries


def plain(pairs):
    """pair -> (prompt, chosen, rejected, chosen spans, rejected spans) from {pair: {side: [(role, text)]}}."""
    out = {}
    for k, sides in pairs.items():
        a, b = sides.get("chosen", []), sides.get("rejected", [])
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        show = lambda t: f"<|{t[0] or ''}|>\n{t[1] or ''}<|end|>\n"
        texts, spans = [], []
        for side in (a, b):
            at, text, own = 0, "", []
            for t in side[n:]:
                if t[0] == "assistant":
                    own.append((at + len("<|assistant|>\n"), at + len(show(t))))
                text, at = text + show(t), at + len(show(t))
            texts.append(text)
            spans.append(own)
        out[k] = ("".join(map(show, a[:n])), *texts, *spans)
    return out


def test_prefix_masks_and_odd_rows(spark):
    u, s = ("user", "hi"), ("system", None)
    pairs = {
        1: {"chosen": [s, u, ("assistant", "good")], "rejected": [s, u, ("assistant", "bad"), u]},
        2: {"chosen": [u, ("assistant", "same")], "rejected": [u, ("assistant", "same")]},
        3: {"chosen": [u, ("assistant", "x")]},
        4: {"chosen": [u], "rejected": [u, ("assistant", "")]},
        5: {"chosen": [(None, "é\U0001f600"), ("assistant", None)], "rejected": [("user", "other")]},
    }
    rows = [(k, side, i, *t) for k, x in pairs.items() for side, turns in x.items() for i, t in enumerate(turns)]
    table = spark.createDataFrame(rows + rows[:2], "pair_id long, side string, turn long, role string, text string")
    got = {r.pair_id: (r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_spans or []], [tuple(x) for x in r.rejected_spans or []]) for r in chat.assembled(chat.formatted(table)).collect()}
    assert got == plain(pairs)
    assert chat.formatted(table.limit(0)).count() == 0


def test_clashing_turns_and_nulls_lose_nothing(spark):
    rows = [
        (1, "chosen", 0, "user", "a"), (1, "chosen", 0, "user", "b"), (1, "rejected", 0, "user", "a"), (1, "rejected", 0, "user", "c"),
        (2, "chosen", None, "user", "x"), (2, "chosen", 1, "assistant", "y"), (2, "rejected", None, "user", "x"), (2, "rejected", 1, "assistant", "z"),
        (None, "chosen", 1, "assistant", "p"), (None, "rejected", 1, "assistant", "q"), (None, "other", 1, "user", "r"),
    ]
    table = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumn("first", F.lit(1)).withColumn("part", F.lit(2))
    got = sorted((r.pair_id or 0, r.part, r.turn if r.turn is not None else -1, r.nth, r.rendered.split("\n")[1][:1]) for r in chat.formatted(table).collect())
    assert got == [(0, "chosen", 1, 1, "p"), (0, "rejected", 1, 1, "q"), (1, "chosen", 0, 2, "b"), (1, "prompt", 0, 1, "a"), (1, "rejected", 0, 2, "c"), (2, "chosen", 1, 1, "y"), (2, "prompt", -1, 1, "x"), (2, "rejected", 1, 1, "z")]


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(queries.OP7_SQL)
    names = [d[0] for d in want.description]
    got = queries.op7_preference(spark, sf)
    assert got.columns == names
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
