import duckdb

from larkseek.llm import quotes
from larkseek.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"


def order(spark, data, schema=SCHEMA):
    got = quotes.reply_order(spark.createDataFrame(data, schema).repartition(3)).collect()
    return {(r["conv_id"], r["message"]): r for r in got}


def test_replies_follow_quotes(spark):
    data = [(1, 0, "user", "How do I sort a list?\n\nAnd how do I reverse it?"),
            (1, 1, "assistant", "Call sort on it."),
            (1, 2, "user", "> And how   do I REVERSE it?\n\nThat is still open."),
            (1, 3, "assistant", "> Call sort on it.\nThis was right.\n> no one said this\nFine."),
            (1, 4, "user", "On Monday Ann wrote:\n> > Call sort on it.\n> This was right.\n\nThanks"),
            (2, 0, "user", "Hello"), (2, 1, "assistant", "Hi"), (2, 2, "user", "Bye")]
    got = order(spark, data)
    assert [(got[1, m]["reply_to"], got[1, m]["link"]) for m in range(5)] == [(None, "root"), (0, "previous"), (0, "quote"), (1, "quote"), (3, "quote")]
    assert got[1, 2]["content"] == "That is still open."
    assert got[1, 3]["content"] == "This was right.\nFine."
    assert got[1, 4]["content"] == "Thanks"
    assert (got[1, 3]["n_quotes"], got[1, 3]["n_linked"]) == (4, 2)
    # chain of 0: 0, 1, 3, 4; message 2 opens its own
    assert [got[1, m]["chain"] for m in range(5)] == [0, 0, 2, 0, 0]
    assert sorted(range(5), key=lambda m: got[1, m]["position"]) == [0, 1, 3, 4, 2]
    assert [(got[2, m]["position"], got[2, m]["reply_to"], got[2, m]["content"]) for m in range(3)] == [(0, None, "Hello"), (1, 0, "Hi"), (2, 1, "Bye")]


def test_quotes_of_nothing_earlier_and_of_other_conversations(spark):
    data = [(1, 0, "user", "> said later\nfirst"), (1, 1, "user", "said later"), (2, 0, "user", "said later"), (2, 1, "user", "> first\nsecond")]
    got = order(spark, data)
    assert (got[1, 0]["link"], got[1, 0]["content"], got[1, 0]["n_linked"]) == ("root", "first", 0)
    assert (got[2, 1]["link"], got[2, 1]["reply_to"]) == ("previous", 0)


def test_long_branching_conversation(spark):
    """Every odd message replies to the one three before it; checked against plain loops."""
    n = 90
    data = [(7, k, "user", (f"> line of {k - 3}\n" if k % 2 and k >= 3 else "") + f"line of {k}") for k in range(n)]
    got = order(spark, data)
    parent = {k: k - 3 if k % 2 and k >= 3 else k - 1 for k in range(1, n)}
    children = {}
    for k, p in parent.items():
        children.setdefault(p, []).append(k)
    chain = {0: 0}
    for k in range(1, n):
        chain[k] = chain[parent[k]] if children[parent[k]][0] == k else k
    want = sorted(range(n), key=lambda k: (chain[k], k))
    assert all(got[7, k]["reply_to"] == p for k, p in parent.items())
    assert sorted(range(n), key=lambda k: got[7, k]["position"]) == want
    place = {k: got[7, k]["position"] for k in range(n)}
    assert sorted(place.values()) == list(range(n)) and all(place[p] < place[k] for k, p in parent.items())


def test_odd_rows(spark):
    data = [(None, 0, "user", None), (None, 1, None, ""), (1, None, "user", "no turn"), (1, 1, "user", "same"), (1, 1, "user", "same"), (1, 2, "x", "> same\n" * 3),
            (2, 0, "user", "a line\n" * 50_000), (2, 1, "user", "> a line\r\n" * 50_000 + "end")]
    got = quotes.reply_order(spark.createDataFrame([(*r, "z", "z", 9) for r in data], SCHEMA + ", message string, content string, part int")).collect()
    assert len(got) == len(data)
    by = {(r["conv_id"], r["message"]): r for r in got}
    assert by[None, 0]["content"] == "" and by[1, 0]["content"] == "no turn"
    assert (by[1, 3]["link"], by[1, 3]["reply_to"], by[1, 3]["content"]) == ("quote", 1, "")
    assert (by[2, 1]["link"], by[2, 1]["content"]) == ("quote", "end")
    assert quotes.reply_order(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_conversation_over_many_ranges(spark):
    data = [(5, k, "user", f"m {k}") for k in range(300)] + [(k + 10, 0, "user", "x") for k in range(30)]
    got = order(spark, data)
    assert all(got[5, k]["turn"] == k == got[5, k]["position"] for k in range(300)) and all(got[k + 10, 0]["position"] == 0 for k in range(30))


def test_render_and_given_table(spark, sf):
    ordered = quotes.reply_order(table(spark, sf, "conversations"))
    source = table(spark, sf, "conversations").orderBy("conv_id", "turn").collect()
    got = ordered.orderBy("conv_id", "position").collect()
    assert [(r["conv_id"], r["turn"], r["content"]) for r in got] == [(r["conv_id"], r["turn"], r["text"]) for r in source]
    chats = quotes.render(ordered, block=2).where("conv_id = 0").orderBy("block").collect()
    first = [r for r in source if r["conv_id"] == 0]
    assert "\n".join(c["chat"] for c in chats) == "\n".join(f"<|{r['role']}|>\n{r['text']}" for r in first)
    assert all(c["n_messages"] <= 2 for c in chats)


def test_sql_twin_on_planted_quotes(spark):
    """The SQL twin and the operator agree where there is something to link."""
    from larkseek.llm.queries import ORACLES
    data = [(1, 0, "user", "How do I sort a list?\n\nAnd how do I reverse it?"), (1, 1, "assistant", "Call sort on it.\nOr sorted."),
            (1, 2, "user", "> And how   do I REVERSE it?\n\nThat is still open."), (1, 3, "assistant", "> Call sort on it.\n> Or sorted.\nThis was right.\n> no one\nFine."),
            (1, 4, "user", "On Monday Ann wrote:\n> > Call sort on it.\n> This was right.\n\nThanks"), (2, 0, "user", "Hello"), (2, 1, None, None),
            (3, 0, "user", ">said later"), (3, 1, "user", "said later"), (None, 0, "user", "a"), (None, 1, "user", " > a\r\nb")]
    data += [(7, k, "user", (f"> line of {k - 3}\n" if k % 2 and k >= 3 else "") + f"line of {k}") for k in range(40)]
    got = sorted((tuple(r) for r in quotes.reply_order(spark.createDataFrame(data, SCHEMA)).collect()), key=repr)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", data)
    assert sorted(con.execute(ORACLES["op10_quotation_linking"]).fetchall(), key=repr) == got
