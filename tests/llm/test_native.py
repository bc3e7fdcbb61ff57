import collections
import re

import duckdb

from courtside.llm import chat, decontaminate, queries


def test_contaminated_against_brute_force(spark, sf_dir):
    word = re.compile(r"[^\W_]+")
    of = lambda t, n=5: (lambda w: [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else [])(word.findall((t or "").lower()))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    passage = items[0][1]
    words = passage.split()
    near = " ".join(w if i != 1 else "changed" for i, w in enumerate(words))
    far = " ".join("other" if i % 5 == 0 else w for i, w in enumerate(words))
    docs += [(9000, f"x y z {near} and more " + "tail " * 40), (9001, f"{far} only"), (9002, passage + " " + passage), (9003, None), (9004, ""), (9005, "one two"), (9006, " ".join(words[2:])), (9007, passage.upper() + "%%%")]
    items += [(900, None), (901, ""), (902, "One, two!"), (903, passage)]
    want = {}
    for d, text in docs:
        a = of(text)
        for i, t in items:
            b = collections.Counter(of(t))
            m = sum(b.values())
            for s in range(max(1, len(a) - m + 1)) if a and m and set(a) & set(b) else []:
                w = collections.Counter(a[s : s + m])
                sim = sum((w & b).values()) / sum((w | b).values())
                if sim >= 0.8 - 1e-12:
                    want[d, i] = max(want.get((d, i), 0), round(sim, 9))
    docs += [docs[0]]
    got = decontaminate.contaminated(spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()}
    assert rows == want and (9000, 0) in want and (9001, 0) not in want and (9005, 902) in want
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated(df.limit(0), items_df).count() == 0 == decontaminate.contaminated(df, items_df.limit(0)).count()
    clean = {r.doc_id for r in decontaminate.decontaminated(df, items_df).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_contaminated_with_null_and_repeated_ids(spark):
    passage = " ".join(f"item{i}" for i in range(30))
    items = spark.createDataFrame([(1, passage), (None, "another item of seven words in all"), (2, None)], "item_id long, text string")
    half = " ".join(passage.split()[:15])
    rest = " ".join(passage.split()[15:])
    rows = [(None, f"before {passage} after"), (None, "clean text without an id"), (7, half), (7, rest), (7, f"{passage} " * 3000), (8, None), (8, "x another item of seven words in all"), (8, "x another item of seven words in all")]
    df = spark.createDataFrame([(*r, 1, 2, "y") for r in rows], "doc_id long, text string, id long, t1 long, item string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(None, 1): 1.0, (7, 1): 1.0, (8, None): 1.0}
    kept = decontaminate.decontaminated(df, items)
    assert kept.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, [rows[1], rows[2], rows[3], rows[5]]))


def test_reply_ordered(spark):
    talk = [
        (1, 0, "user", "Hello there.\n\nHow is the weather today?"),
        (1, 1, "assistant", "It is sunny."),
        (1, 2, "user", "> How is   the WEATHER today?\nI asked first."),
        (1, 3, "user", "On Monday X wrote:\n> I asked first.\n>> How is the weather today?\nYes you did."),
        (1, 4, "user", "> > It is sunny.\nnested only"),
        (1, 5, "user", "> never said\nno link"),
        (1, 6, "user", "> Yes you did.\n> \n>> I asked first.\nend"),
        (2, 0, "user", "> It is sunny.\nother conversation"),
        (3, 0, None, None),
        (3, 1, "user", ""),
        (None, 1, "user", "> x"),
        (4, 2, "user", "same"),
        (4, 2, "user", "same"),
        (4, 3, "user", "> same\nreply"),
        (4, 4, "user", "> reply"),
    ]
    got = {(r.conv_id, r.turn, r.text): (r.reply_to, r.thread_root, r.depth) for r in chat.reply_ordered(spark.createDataFrame([(*r, 1) for r in talk], "conv_id long, turn long, role string, text string, depth int")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", talk)
    sql = con.execute(f"SELECT conv_id, turn, text, reply_to, thread_root, depth FROM ({queries.threads_sql('SELECT * FROM conversations')})").fetchall()
    assert {r[:3]: r[3:] for r in sql} == got and len(sql) == len(talk)
    assert got[1, 2, "I asked first."] == (0, 0, 1)
    assert got[1, 3, "Yes you did."] == (2, 0, 2)
    assert got[1, 4, "nested only"] == (1, 1, 1)
    assert got[1, 5, "no link"] == (None, 5, 0)
    assert got[1, 6, "end"] == (3, 0, 3)
    assert got[2, 0, "other conversation"] == (None, 0, 0)
    assert got[3, 0, ""] == (None, 0, 0) and got[3, 1, ""] == (None, 1, 0)
    assert got[None, 1, ""] == (None, 1, 0)
    assert got[4, 3, "reply"] == (2, 2, 1) and got[4, 4, ""] == (3, 2, 2)
    assert chat.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_wrapped_paragraphs_and_sentences_link(spark):
    parts = ["The first paragraph tells how the season began, with a long run of narrow wins. It ends here.", "The second is about the players who were hurt in the autumn. Nobody expected them back so soon!", "The third asks what comes next."]
    wrapped = "> The first paragraph tells how the season\n> began, with a long run of narrow\n> wins. It ends here.\n>\n> The second is about the players who\n> were hurt in the autumn. Nobody\n> expected them back so soon!\n"
    talk = [
        (1, 0, "user", "Shall we talk about the season?"),
        (1, 1, "assistant", "\n\n".join(parts)),
        (1, 2, "user", wrapped + "I did expect them."),
        (1, 3, "assistant", "> Nobody expected them\n> back so soon!\nWell."),
        (1, 4, "user", ">> Nobody expected them\n>> back so soon!\n> Well.\nIndeed."),
        (1, 5, "user", "> Nobody expected\nnot a whole sentence"),
    ]
    rows = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.reply_to, r.thread_root, r.depth) for r in chat.reply_ordered(rows).collect()}
    # by hand: the earliest message that says one of the quoted paragraphs, lines or sentences
    units = lambda t: {chat_words(u) for p in re.split(r"\n\s*\n", t) for u in [p, *p.split("\n"), *re.split(r"(?<=[.!?])\s+", p)]} - {""}
    chat_words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    for turn, quoted in ((2, wrapped), (3, talk[3][3]), (5, talk[5][3])):
        said = "\n".join(re.sub(r"^>\s?", "", line) for line in quoted.split("\n") if line.startswith(">"))
        first = [t for _, t, _, text in talk[:turn] if units(said) & units("\n".join(x for x in text.split("\n") if not x.startswith(">")))]
        assert got[turn][0] == (first[0] if first else None)
    assert got == {0: (None, 0, 0), 1: (None, 1, 0), 2: (1, 1, 1), 3: (1, 1, 1), 4: (3, 1, 2), 5: (None, 5, 0)}


def test_mail_is_linked_as_it_was_quoted(spark, sf_dir):
    """Conversations without quotes stay as they are; of those that quote, every reply finds its message, whatever the depth."""
    said = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    names = ["conv_id", "turn", "role", "reply_to", "thread_root", "depth", "quoted_lines", "text"]
    sql = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op4_quotation_threads']})").fetchall()
    rows = queries.op4_quotation_threads(spark, sf_dir).select(*names).collect()
    assert sorted(map(repr, sql)) == sorted(repr(tuple(r)) for r in rows)
    assert {(r.conv_id, r.turn): r.text for r in rows if r.conv_id >= 0} == said
    mail = {(-r.conv_id - 1, r.turn): r for r in rows if r.conv_id < 0}
    assert mail.keys() == said.keys() and all(r.text.strip() == said[k].strip() for k, r in mail.items())
    for (conv, turn), r in mail.items():
        before = [t for t in range(turn) if (conv, t) in said and said[conv, t] == said.get((conv, turn - 1))]
        want = before[0] if turn % 5 and before else None
        if want is None or want == turn - 1:  # an earlier message that said the same takes the link
            assert r.reply_to == want and (want is None) == (r.quoted_lines == 0)
    assert sum(r.depth >= 2 for r in mail.values()) > len(mail) / 4 and max(r.depth for r in mail.values()) == 4


def test_contaminated_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, item_id, similarity FROM ({queries.ORACLE_SQL['op3_decontamination']})").fetchall())
    assert want and sorted(tuple(r) for r in queries.op3_decontamination(spark, sf_dir).collect()) == want
