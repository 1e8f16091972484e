import random

import duckdb
import numpy as np
import pytest

from sonde.llm import line_templates as lt
from sonde.llm import url_reputation as ur


def prose(r, n):
    return " ".join("".join(r.choice("aeioustnr") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_recurring_templates_go_and_copies_stay(spark):
    r, rows = random.Random(1), []
    for i in range(40):
        boiler = f"Page {r.randint(1, 999)} printed by {prose(r, 1)} on the old press of the town"
        rows.append((i, f"{prose(r, 30)}\n{boiler}\n\n{prose(r, 25)}\nAll rights reserved."))
    base = [prose(r, 20) for _ in range(5)]
    for i in range(100, 130):  # near copies: one word each
        lines = list(base)
        words = lines[i % 5].split()
        words[3] = prose(r, 1)
        lines[i % 5] = " ".join(words)
        rows.append((i, "\n".join(lines)))
    rows += [(i, "\n".join(base)) for i in range(200, 220)]
    df = spark.createDataFrame([(*x, 5, 7) for x in rows], "doc_id long, text string, n_lines int, leaf int")
    got = {x["doc_id"]: x for x in lt.drop_recurring_lines(df).collect()}
    for i, t in rows:
        lines = t.split("\n")
        want = [x for x in lines if not x.startswith("Page ") and x != "All rights reserved."]
        assert got[i]["text"] == "\n".join(want) and got[i]["n_dropped"] == len(lines) - len(want) and got[i]["n_lines"] == len(lines)
        assert got[i]["leaf"] == 7


def test_join_path_gives_the_same(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, f"{prose(r, 30)}\nsame old line {i}\n{prose(r, 9)}") for i in range(30)] + [(None, None), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(str, lt.drop_recurring_lines(df).collect()))
    monkeypatch.setattr(lt, "SENT_KEYS", -1)
    assert sorted(map(str, lt.drop_recurring_lines(df).collect())) == few
    assert sum("n_dropped=1" in x for x in few) == 30 and any("text=None, n_lines=0" in x for x in few)
    assert lt.drop_recurring_lines(df.limit(0)).collect() == []


def dropped(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return {x["doc_id"]: x["n_dropped"] for x in lt.drop_recurring_lines(df).collect()}


def copies(r, base, n):
    """``n`` near copies of ``base``, one word replaced in each."""
    for _ in range(n):
        words = base.split(" ")
        words[r.randrange(len(words))] = prose(r, 1)
        yield " ".join(words)


def test_long_repeats_in_few_documents_go(spark, monkeypatch):
    r = random.Random(3)
    line, runs, short = prose(r, 60), [prose(r, n) for n in (30, 12, 14, 9)], prose(r, 40)
    rows = [f"{prose(r, 70)}\n{line}\n{prose(r, 9)}" for _ in range(3)]
    rows += ["\n".join([prose(r, 80), *runs, prose(r, 80)]) for _ in range(2)]  # lines of a run are short, the run is not
    rows += ["\n".join([f"{prose(r, 70)} {runs[1]}", runs[0], f"{runs[2]} {prose(r, 50 + i)}"]) for i in range(2)]  # begins and ends in a line
    rows += [f"{prose(r, 70)}\n{short}\n{prose(r, 70)}" for _ in range(2)]
    rows += [f"{x}\n{prose(r, 1)}" for x in copies(r, prose(r, 200), 3)]
    want = dict(enumerate([1] * 3 + [4] * 2 + [1] * 2 + [0] * 5))
    assert dropped(spark, rows) == want
    monkeypatch.setattr(lt, "SENT_KEYS", -1)
    assert dropped(spark, rows) == want


def test_winnowing_picks_a_run_in_every_passage():
    r = np.random.default_rng(1)
    sizes = [0, 3, 49, 50, 51, 400, 0, 200]
    h, start = r.integers(0, 2**63, sum(sizes)).astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)])
    h[110:170] = h[110]
    key, whole = lt._windows(h, start, lt.LONG)
    at = [s + i for s, n in zip(start, sizes) for i in range(n - lt.LONG + 1)]
    assert list(np.flatnonzero(whole)) == at
    picked, _ = lt._picked(h, start)
    assert all(((picked >= i) & (picked <= i + lt.LONG - lt.GRAM)).any() for i in at) and picked.min() >= 52
    same = lt._windows(np.concatenate([h[:7], h[200:260]]), np.array([0, 67]), lt.LONG)[0]
    assert list(same[7:]) == list(key[200:211]) and len(set(key[at].tolist())) == len(set(tuple(h[i : i + lt.LONG]) for i in at))


def test_lines_are_cut_from_bytes_as_from_lists():
    for seed in range(2000):
        r = random.Random(seed)
        texts = ["".join(r.choice("ab\n\né") for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 4))]
        gone = [(d, n) for d, t in enumerate(texts) for n in range(t.count("\n") + 1) if r.random() < 0.4]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
        left, ends, had = lt._without(raw, offs, np.array([d for d, _ in gone], int), np.array([n for _, n in gone], int))
        want = ["\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in enumerate(texts)]
        assert [left[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])] == want and had.tolist() == [t.count("\n") + 1 for t in texts]


def test_clouds_of_near_copies_do_not_shield_boilerplate(spark):
    r = random.Random(4)
    notice = "this text is under the licence of the old press"
    for clouds, others in (([1500], 12), ([100, 60, 60], 30)):
        rows = [f"{x}\n{notice}" for n in clouds for x in copies(r, prose(r, 150), n)]
        rows += [f"{prose(r, 60)}\n{notice}" for _ in range(others)]
        assert set(dropped(spark, rows).values()) == {1}
        assert set(dropped(spark, rows[: sum(clouds)]).values()) == {0}  # a cloud has one vote


def by_hand(texts, least, votes=None):
    """The lines dropped: sets of (text, line). ``votes``: that of each text (without: one of its own)."""
    import re

    vote = votes or list(range(len(texts)))

    word = re.compile(r"[^\x20\x09-\x0d]+")
    lines = {(d, n): ["#" if re.search("[0-9]", w) else w.lower() for w in word.findall(x)] for d, t in enumerate(texts) for n, x in enumerate(t.split("\n"))}
    lines = {k: v for k, v in lines.items() if v}
    leaves, out = {}, set()
    for k, v in lines.items():
        for leaf in {(len(v), "lead", *v[:3]), (len(v), "lead" if len(v) <= 3 else "tail", *(v[:3] if len(v) <= 3 else v[-3:]))}:
            leaves.setdefault(leaf, []).append(k)
    for own in leaves.values():
        held, seen = {}, {}
        for k in own:
            for place, w in enumerate(lines[k]):
                held.setdefault((place, w), set()).add(vote[k[0]])
        for k in own:
            fixed = [w if w != "#" and len(held[place, w]) >= least else None for place, w in enumerate(lines[k])]
            if 2 * sum(x is not None for x in fixed) >= len(fixed):
                seen.setdefault(tuple(fixed), set()).add(k)
        out |= {k for found in seen.values() if len({vote[d] for d, _ in found}) >= least for k in found}
    runs, windows = [[(w.lower(), n) for n, x in enumerate(t.split("\n")) for w in word.findall(x)] for t in texts], {}
    for d, words in enumerate(runs):
        for i in range(len(words) - 49):
            windows.setdefault(tuple(w for w, _ in words[i : i + 50]), set()).add(vote[d])
    for d, words in enumerate(runs):
        cover = [False] * len(words)
        for i in range(len(words) - 49):
            if len(windows[tuple(w for w, _ in words[i : i + 50])]) >= 2:
                cover[i : i + 50] = [True] * 50
        for n in {n for _, n in words}:
            if all(c for c, (_, m) in zip(cover, words) if m == n):
                out.add((d, n))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_a_parser_by_hand_agrees(spark, seed):
    r, texts = random.Random(seed), []
    passage = prose(r, 30) + "\n" + prose(r, 35)
    for i in range(60):
        lines = [prose(r, 70)]
        for _ in range(r.randint(1, 5)):
            lines.append(" ".join(r.choice(["ax", "bo", "7"] if r.random() < 0.85 else [prose(r, 1)]) for _ in range(r.choice([1, 2, 3, 4, 5, 7]))))
        if i % 20 == 0:
            lines.append(passage)
        r.shuffle(lines)
        texts.append("\n".join(lines))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in lt.drop_recurring_lines(df, min_docs=4).collect()}
    gone = by_hand(texts, 4)
    assert 30 < len(gone) < sum(t.count("\n") + 1 for t in texts) - 60
    for d, t in enumerate(texts):
        assert got[d] == "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)


def test_leading_words_may_vary(spark):
    r = random.Random(6)
    forms = ["Posted by {} in the daily news of our town", "Posted {} him in the daily news of our town", "{} by him in the daily news of our town", "{} {} {} in the daily news of our town", "By {} for the evening news of our land"]
    rows = [f"{prose(r, 60)}\n{forms[i % 5].format(*(prose(r, 1) for _ in range(3)))}\n{prose(r, 20)}" for i in range(60)]
    assert set(dropped(spark, rows).values()) == {1}


def test_odd_tables(spark):
    assert lt.drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = "\n".join(f"line {i} of a very long text " + "word " * 50 for i in range(4000)) + "x" * 3_000_000
    rows = [(1, None, 1, 2), (None, "", 1, 2), (2, long, 1, 2), (2, long, 1, 2), (3, " \n\n", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, drop int, key int")
    got = sorted(lt.drop_recurring_lines(df).collect(), key=str)
    assert len(got) == 5 and {(x["drop"], x["key"]) for x in got} == {(1, 2)}
    assert {(x["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for x in got} == {(1, None, 0, 0), (None, "", 1, 0), (2, long, 4000, 0), (3, " \n\n", 3, 0)}


def test_a_shared_passage_does_not_make_documents_copies(spark):
    r = random.Random(5)
    passage = prose(r, 40)
    assert set(dropped(spark, [f"{prose(r, 40)}\n{passage}" for _ in range(20)]).values()) == {1}


URLS = [
    (1, "https://www.Example.com/en/x?q#f"), (2, "http://a.example.com/en/"), (3, "http://b.net/es/1"), (4, "http://b.net"), (5, "x.net/es/"), (6, None), (7, "ftp://COM/"), (8, "http://notexample.com/en/"),
    (9, "http://ÄB.net/fr/ä"), (9, "http://h.org?x=://y.net/es/"), (None, "http://h.org/#/en/"), (10, "://"), (11, "http://x.co.uk/a"),
]


def test_rules_hosts_and_paths(spark):
    pages = spark.createDataFrame([(*u, "z") for u in URLS], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in ur.judge_urls(pages, labels).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/", "example.com/en/", "block"), (3, "b.net", "/es/1", "net/es/", "block"), (4, "b.net", "", None, "allow"),
            (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "com", "/", "com/", "allow"), (8, "notexample.com", "/en/", "com/", "allow"), (9, "Äb.net", "/fr/ä", "net/fr/", "block"),
            (9, "h.org", "", None, "allow"), (None, "h.org", "/", None, "allow"), (10, "", "", None, "allow"), (11, "x.co.uk", "/a", None, "allow"),
        ],
        key=str,
    )


def test_bad_hosts_are_blocked_and_small_samples_are_not(spark):
    pages = [(i, f"http://bad.org/{i}") for i in range(60)] + [(i, f"http://good{i % 5}.org/{i}") for i in range(60, 300)] + [(300, "http://once.org/1"), (301, "http://new.org/2")]
    labels = [(i, 1) for i in range(40)] + [(i, 0) for i in range(60, 250)] + [(300, 1), (300, 0)]
    got = {r["page_id"]: r["verdict"] for r in ur.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert {got[i] for i in range(60)} == {"block"} and {got[i] for i in range(60, 302)} == {"allow"}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_sql_gives_the_same(spark, scale):
    from sonde.llm.queries import op5_url_filter, oracle_sql

    sf = f"/root/testdata/{scale}"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(oracle_sql()["op5_url_filter"]).fetchall()
    assert sorted(map(tuple, op5_url_filter(spark, sf).collect()), key=str) == sorted(want, key=str)
