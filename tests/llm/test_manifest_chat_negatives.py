"""Hard negatives, chat formatting and the Merkle manifest against brute force, round trips and odd inputs."""

import hashlib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import chat, merkle, negatives

# op11

VECTORS = "vec_id long, label int, embedding array<double>, score string, row string"


def brute_negatives(rows, positives=5, negatives_=10):
    sound = [(i, (r[1] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[1], [int(np.floor(256 * x)) for x in r[2]], r[0]) for i, r in enumerate(rows) if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    by = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, label, q, id in sound:
        if id is None or id % 100:
            continue
        found = [(sum(a * b for a, b in zip(q, p)), other, label == own) for j, own, p, other in sound if j != i]
        for p in sorted((x for x in found if x[2]), key=by)[:positives]:
            fit = sorted((x for x in found if not x[2] and 30 * p[0] <= 100 * x[0] <= 90 * p[0]), key=by)[:negatives_]
            out += [(id, p[1], n, x[1], p[0], x[0]) for n, x in enumerate(fit, 1)]
    return out


def mined(spark, rows):
    got = negatives.mined_digest(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS))
    return [tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def some(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        for name, size in (("ANCHORS", 2), ("ROWS", 40), ("TILE", 50)):
            monkeypatch.setattr(negatives, name, size)
    chance = np.random.default_rng(3)
    centres = chance.normal(size=(4, 6))
    rows = [(int(i), int(chance.integers(4)), [float(x) for x in (centres[i % 4] + chance.normal(size=6)) / 4]) for i in range(300)]
    rows[5] = (5, None, rows[5][2])
    rows[6] = (6, 1, None)
    rows[8] = (8, 1, [float("nan")] * 6)
    rows[9] = (9, 1, [float("inf")] + [0.0] * 5)
    rows[10] = (10, 1, [None] + [0.0] * 5)
    rows[11] = (11, 1, [0.1, 0.2])  # shorter
    rows[12] = (12, 1, [])
    rows[200] = (200, 2, [0.0] * 6)  # an anchor whose scores are all nought
    rows += [(301, r[1], r[2]) for r in rows[20:24]]  # ties and a repeated id
    assert some(mined(spark, rows)) == some(brute_negatives(rows))


def test_hard_negatives_of_odd_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [0.5, 0.5])]) == []
    assert mined(spark, [(100, 1, [0.5]), (1, 1, [0.5]), (2, 1, [0.25])]) == []  # no other label
    same = [(i, i % 2, [0.5, 0.5]) for i in range(101)]
    assert some(mined(spark, same)) == some(brute_negatives(same))
    large = [(0, 1, [3.0e5, -2.0e5]), (1, 2, [3.0e5, 1.0]), (2, 1, [1.0e5, 1.0e5]), (3, 2, [2.0e5, 1.0e5]), (4, 2, [0.5, 0.5]), (100, 3, [1.0e11, 0.0]), (101, 3, [1.0e11, 1.0]), (102, 3, [1.0e13, 0.0])]
    got = some(mined(spark, large))
    assert [r for r in got if r[0] == 0] == [r for r in some(brute_negatives(large[:5]))]


def test_bit_planes_are_exact_and_drop_candidates():
    chance = np.random.default_rng(4)
    for largest, width in ((3, 5), (200, 64), (1 << 30, 8), (1 << 40, 3)):
        a, rows = (chance.integers(-largest, largest + 1, size=(n, width)) for n in (7, 150))
        scores = np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in rows] for p in a], object)
        meets = chance.random((7, 150)) < 0.7
        low = np.array([[min(max(int(x), -(1 << 62)), 1 << 62) for x in np.sort(r)[[30, 90]]] for r in scores], np.int64)
        high = np.array([[min(max(int(x), -(1 << 62)), 1 << 62) for x in np.sort(r)[[80, 140]]] for r in scores], np.int64)
        of, band, to, got = negatives.bit_sliced(a, rows, meets, low, high, 4)
        for i in range(7):
            for b in range(2):
                fit = sorted((int(s) for s, m in zip(scores[i], meets[i]) if m and low[i, b] <= s <= high[i, b]), reverse=True)
                want = [s for s in fit if s >= fit[:4][-1]] if fit else []
                if largest < 1 << 40:
                    assert sorted((int(x) for x in got[(of == i) & (band == b)]), reverse=True) == want


# op12

CONVERSATIONS = "conv_id long, turn long, role string, text string, segments string, turns int"


def brute_chat(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = {}
    for conv, turns in out.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        found[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(learned), sha(learned))
    return found


def test_chat_digest(spark):
    nasty = ["", None, "[INST]", "a\\[INST]\\\\", "</s><s>", "\\", "[[INST][/INST]]", "é漢\U0001f600\x00", "x" * 400_000, "[\\INST]", "[ROLE]user[/ROLE]hi[/TURN]", "tab\there\n\n"]
    rows = [(i % 5, i, role, text) for i, (role, text) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "system", "tool", "[/ROLE]", None, "User"))]
    rows += [(9, 0, "user", "same")] * 2 + [(9, None, "assistant", "first"), (None, 1, "user", "lost"), (None, 0, "assistant", "found")]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.chat_digest(spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS)).collect()}
    assert got == brute_chat([*rows, (-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)])
    only = chat.chat_digest(spark.createDataFrame([], CONVERSATIONS)).collect()
    assert [r["conv_id"] for r in only] == [-7]


def test_formatted_text_reads_back(spark):
    chance = np.random.default_rng(5)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]", "[SYS]", "\\", "[", "<", "a", "\n", "INST]"]
    turns = [[(["user", "assistant", "tool", ""][int(chance.integers(4))], "".join(chance.choice(bits, size=int(chance.integers(0, 12))))) for _ in range(int(chance.integers(0, 6)))] for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], f"conv_id long, turns {chat.TURNS}")
    back = chat.formatted(df).select("conv_id", chat.parsed(F.col("formatted")).alias("turns"), "formatted", chat.joined(F.col("segments")).alias("whole"))
    for r in back.collect():
        assert [tuple(t) for t in r["turns"]] == turns[r["conv_id"]] and r["formatted"] == r["whole"]


def test_fingerprints_select_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "hi"}, {"content": "yo", "role": "assistant"}]}, "messages", [("user", "hi"), ("assistant", "yo")]),
        ({"messages": []}, "messages", []),
        ({"conversations": [{"from": "Human", "value": "a"}, {"from": "gpt", "value": None}]}, "from and value", [("user", "a"), ("assistant", "")]),
        ({"output": "done", "instruction": "do", "input": ""}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"output": "done", "instruction": "do", "input": "more", "system": "s"}, "instruction", [("system", "s"), ("user", "do\n\nmore"), ("assistant", "done")]),
        ({"prompt": "p", "completion": 3}, "prompt", [("user", "p"), ("assistant", "3")]),
        ({"prompt": "p", "response": "r", "system": ""}, "prompt and response", [("user", "p"), ("assistant", "r")]),
        ({"prompt": None, "response": "r"}, "prompt and response", [("user", ""), ("assistant", "r")]),
        ({"prompt": "p", "response": "r", "more": 1}, None, None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(90, "no json"), (91, None), (92, ""), (93, "[]")]
    got = {r["conv_id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.json_conversations(spark.createDataFrame(rows, "id long, record string"), "id", "record").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i][0] == layout and (got[i][1] or []) == (turns or [])
    assert all(got[i][0] is None for i in (90, 91, 92, 93))
    # A table's fingerprint is that of its records.
    for record, layout, turns in (records[0], records[5]):
        table = spark.read.json(spark.createDataFrame([(json.dumps(record),)], "value string").rdd.map(lambda r: r[0]))
        assert chat.by_fingerprint()[chat.fingerprint(chat.schema_paths(table.schema))][0].name == layout
        assert [tuple(t) for t in chat.conversations(table).first()["turns"]] == turns
    with pytest.raises(ValueError):
        chat.conversations(spark.createDataFrame([(1, 2)], "a int, b int"))


def test_chat_plan_is_native(spark):
    plan = chat.chat_digest(spark.createDataFrame([], CONVERSATIONS))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# op13

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, leaf string, _n int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc, raised=False):
    doc_id, text, lang, source, n_chars = doc
    if raised and n_chars is not None and n_chars < (1 << 63) - 1:
        n_chars += 1
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = level[i // arity * arity : i // arity * arity + arity]
            path.append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
            i //= arity
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(docs, arity=2):
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    under, tops = {}, []
    for g in keys:
        groups[g].sort(key=lambda d: (d[0] is not None, d[0] or 0, brute_leaf(d)))
        top, paths = brute_tree([brute_leaf(d) for d in groups[g]], arity)
        under[g] = paths
        tops.append(top)
    root, above = brute_tree(tops, arity)
    out = []
    for k, g in enumerate(keys):
        for d, path in zip(groups[g], under[g]):
            path = path + above[k]
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            node = brute_leaf(d, tampered)
            for before, after in path:
                node = sha(before, node, after)
            out.append((d[0], brute_leaf(d), tops[k], root, sha(*(b + a for b, a in path)), node, node == root))
    return out


def manifest(spark, docs):
    rows = merkle.manifest_digest(spark.createDataFrame([(*d, "p", "l", 1) for d in docs], DOCS))
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in rows.collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 65, 260])
def test_manifest(spark, n):
    docs = [(i, f"text {i} é", ["en", "de", "ß", "A"][i % 4 if i % 3 else 0], "s", i) for i in range(n)]
    assert sorted(manifest(spark, docs)) == sorted(brute_manifest(docs) if docs else [])


def test_manifest_of_odd_rows(spark):
    docs = [(None, None, None, None, None), (None, "a", None, "s", 1), (5, "", "", "", 0), (5, "", "", "", 0), (5, "x" * 100_000, "", "s", 3), (-7, "1:é", "en", None, (1 << 63) - 1), (9, "z", "en", "s", None)]
    docs += [(i, "t", "hot", "s", 1) for i in range(200)]
    some_ = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    assert some_(manifest(spark, docs)) == some_(brute_manifest(docs))


def test_manifest_of_other_runs(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 9)
    docs = [(i, f"t{i}", "en" if i % 5 else "fr", "s", i) for i in range(100)]
    rows = merkle.manifest(spark.createDataFrame([(*d, "p", "l", 1) for d in docs], DOCS), "lang", "doc_id", merkle.DOCUMENT, arity=3)
    got = sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], sha(*(s["before"] + s["after"] for s in r["path"]))) for r in rows.collect())
    assert got == sorted(r[:5] for r in brute_manifest(docs, 3))
    assert rows.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


@pytest.mark.parametrize("table, digest, sql, keys", [("embeddings", negatives.mined_digest, negatives.SQL, 3), ("conversations", chat.chat_digest, chat.SQL, 1), ("documents", merkle.manifest_digest, merkle.SQL, 1)])
def test_given_tables_match_sql(spark, table, digest, sql, keys):
    import duckdb

    path = f"/root/testdata/sf0.001/{table}.parquet"
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{path}'")
    want = con.execute(sql).df()
    got = digest(spark.read.parquet(path)).toPandas()[list(want.columns)]
    order = list(want.columns[:keys])
    assert got.sort_values(order).astype(str).values.tolist() == want.sort_values(order).astype(str).values.tolist()


# op7, op10 and odd columns


def drawn(chance, letters, n):
    return "".join(letters[int(i)] for i in chance.integers(len(letters), size=n))


@pytest.fixture(scope="module")
def tagger():
    from panelweave.llm import secrets

    chance = np.random.default_rng(31)
    spoken = ["".join(drawn(chance, "bdfglmnprst", 1) + drawn(chance, "aeiou", 1) for _ in range(int(chance.integers(1, 5)))) for _ in range(800)]
    texts = [" ".join(spoken[int(i)] for i in chance.integers(800, size=120)) for _ in range(300)]
    return secrets.Tagger(secrets.fitted([w for t in texts for w in secrets.tagged(t, 2, 16)])), texts


def found_share(tagger, make, n=150):
    field, texts = tagger
    chance, hits = np.random.default_rng(32), 0
    for i in range(n):
        words, made = texts[i % len(texts)].split()[:14], make(chance)
        at = int(chance.integers(len(words)))
        start = len(" ".join(words[:at])) + (at > 0)
        spans = field.spans(" ".join([*words[:at], *made, *words[at:]]))
        hits += any(a < start + len(" ".join(made)) and start < b for a, b in spans)
    return hits / n


HEX, ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Clean tokens, most of them of forms that the fit is not shown.
CLEAN = {
    "address of six parts": lambda c: [":".join(drawn(c, HEX, 4) for _ in range(8))],
    "hardware address": lambda c: [":".join(drawn(c, HEX, 2) for _ in range(6))],
    "message id": lambda c: [f"<CA+{drawn(c, ALNUM, 20)}={drawn(c, ALNUM, 10)}@mail.example.com>"],
    "formula": lambda c: ["CC(=O)OC1=CC=CC=C1C(=O)O"[: int(c.integers(8, 24))]],
    "digest": lambda c: [f"sha512-{drawn(c, ALNUM + '+/', 86)}=="],
    "data": lambda c: [f"data:application/pdf;base64,{drawn(c, ALNUM + '+/', 200)}"],
    "video": lambda c: [f"https://www.example.com/watch?v={drawn(c, ALNUM + '-_', 11)}&t=4"],
    "document": lambda c: [f"https://drive.example.com/file/d/{drawn(c, ALNUM + '-_', 40)}/view"],
    "article number": lambda c: [f"10.1038/s{drawn(c, '0123456789', 5)}-{drawn(c, '0123456789', 3)}-{drawn(c, '0123456789', 5)}-{drawn(c, HEX, 1)}"],
    "parcel": lambda c: ["JD" + drawn(c, "0123456789", 18)],
}
SECRET = {
    "password in an address": lambda c: [f"postgresql://admin:{drawn(c, ALNUM, 12)}@db.example.io:5432/app"],
    "prefixed": lambda c: ["ghp_" + drawn(c, ALNUM, 36)],
    "signed": lambda c: [f"eyJ{drawn(c, ALNUM, 30)}.eyJ{drawn(c, ALNUM, 40)}.{drawn(c, ALNUM + '-_', 43)}"],
    "words": lambda c: ["passphrase:", *(drawn(c, "abcdefghijklmnopqrstuvwxyz", int(c.integers(4, 8))) for _ in range(4))],
    "bearer": lambda c: ["Authorization:", "Bearer", drawn(c, ALNUM, 32)],
}


def test_field_spares_clean_tokens_and_finds_secrets(tagger):
    clean = {name: found_share(tagger, make) for name, make in CLEAN.items()}
    assert max(clean.values()) <= 0.06 and sum(clean.values()) / len(clean) <= 0.02, clean
    secret = {name: found_share(tagger, make) for name, make in SECRET.items()}
    assert min(secret.values()) >= 0.8, secret


def test_html_keeps_text_of_equal_pages_and_shared_titles(spark):
    from panelweave.llm import html

    same = "<body><div class=text><p>one</p><p>two</p></div></body>"
    title = "<body><div class=top>Top of the site</div><h1>A title</h1><div class=text><p>page {}</p></div></body>"
    inside = "<article><h1>T</h1>{}</article>"
    cases = [
        ("http://a.com/1", same, "one\ntwo"), ("http://a.com/1", same, "one\ntwo"), ("http://a.com/2", same, "one\ntwo"),
        ("http://b.com/1", title.format(1), "A title\npage 1"), ("http://b.com/2", title.format(2), "A title\npage 2"),
        *((f"http://c.com/{i}", title.format(i), f"page {i}") for i in range(3)),
        *(("http://d.com/1", inside.format(f"<{tag} class='{name}'>kept</{tag}>"), "T\nkept") for tag, name in (("div", "search-results"), ("div", "login-page"), ("section", "menu"), ("div", "promo-code"), ("h2", "comment"))),
        *(("http://e.com/1", inside.format(f"<div {mark}><p>reader</p></div>"), "T") for mark in ("id=reader-comments", "id='replies'", "class='comment-list'", "class=gdpr-bar", "class='ad-slot'")),
        ("http://f.com/1", "<body><div class=toolbar>tools</div><p>kept</p></body>", "kept"),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_digest(pages).collect()}
    assert [(i, got[i]) for i in range(len(cases))] == [(i, text) for i, (_, _, text) in enumerate(cases)]


def test_clashing_columns_and_text_ids(spark, tmp_path):
    import corpus_pipeline
    from panelweave.llm import grading, jaccard

    chance = np.random.default_rng(33)
    words = [drawn(chance, "abcdefghij", 5) for _ in range(300)]
    texts = [" ".join(words[int(i)] for i in chance.integers(300, size=60)) for _ in range(40)]
    texts[1] = texts[0]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, KEPT_ string, expected_grade int, _graded int, _spans string, tail_probability string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "k", "K", 1, 2, "spans", "t") for i, t in enumerate(texts)], schema)
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    graded = grading.grade_documents(docs, labels)
    assert len({c.casefold() for c in graded.columns}) == len(graded.columns) and dict(graded.dtypes)["kept"] == "boolean" and graded.count() == 40
    for stage in (corpus_pipeline.quality, corpus_pipeline.secret_removal):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {(r["_spans"], r["_graded"], r["kept"]) for r in out.collect()} <= {("spans", 2, "k")}
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")))
    rows = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(named).collect()}
    assert rows["d001"] == rows["d000"] == "d000" and rows["d002"] == "d002" and len(rows) == 40
    assert jaccard.one_of_each(named).count() == 39


def test_url_weights_decide(spark):
    from panelweave.llm import urls

    cases = {"http://a.com/free/deals": "allow", "http://a.com/free/deals/coupon": "allow", "http://a.com/free/deals/coupon/win": "block", "http://a.com/dating/singles": "block", "http://a.com/dating/free": "allow", "http://a.com/poker/free": "block", "http://a.com/casino": "block", "http://a.com/poker": "allow"}
    rows = urls.judge_urls(spark.createDataFrame(list(enumerate(cases)), "page_id long, url string"), ()).collect()
    assert {list(cases)[r["page_id"]]: r["verdict"] for r in rows} == cases
