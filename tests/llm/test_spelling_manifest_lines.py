"""op11, op12 and op13 against plain Python and their SQL twins, on rows with all that is odd."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from glyphmill.llm import line_rules, manifest, oracle, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    syllables = ["ba", "na", "tro", "él", "Ümi", "ß", "x", "aa", "STO", "ré"]
    stems = ["".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(40)]

    def word():
        w = rng.choice(stems)
        if rng.random() < 0.3:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeÿZ") + w[i:], w[:i] + rng.choice("aeÿZ") + w[i + 1 :]])
        return w

    shared = ["All rights  reserved 2024", "Menu | Home\t| About", "one two three four five six"]
    out = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 5))]
        lines += rng.sample(shared, rng.randint(0, 2)) * rng.randint(1, 2)
        out.append((i, "\n".join(lines) + rng.choice(["", "\n\n", " #*$ "]), rng.choice(["en", "de", None, "zz", ""]), rng.choice(["src0", "src1", None]), 7))
    return out


ODD = [
    (None, "null id and some more words of a text that is long enough", "en", "src0", 1),
    (None, "another null id", "en", None, None),
    (5000, None, None, None, None),
    (5001, "", "en", "src0", 0),
    (5002, " \n\t ", "en", "src0", 3),
    (5003, "日本語 テキスト 😀 naïve\x0bcafé\x0cΑλφα " * 3, "ja", "src0", 3),
    (5004, "again and again and again and again and again and again", "en", "src0", 9),
    (5004, "again and again and again and again and again and again", "en", "src0", 9),
    (5005, "same id once", "en", "src0", 9),
    (5005, "same id twice", "en", "src0", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(150, 3) + ODD * 2, SCHEMA).repartition(5).cache()


def by_sql(sql: str, rows: list[tuple]) -> list[tuple]:
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    return con.sql(sql)


def same(df, relation) -> int:
    names = df.columns
    assert sorted(names) == sorted(relation.columns)
    got = Counter(map(repr, (tuple(r) for r in df.collect())))
    wanted = Counter(map(repr, relation.project(", ".join(f'"{n}"' for n in names)).fetchall()))
    assert got == wanted
    return sum(got.values())


# ---- op11 --------------------------------------------------------------------------------------


def plain_variants(rows, min_count=3):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        beside = [v for v in words if v != w and near(w, v)]
        form = min(beside, key=lambda v: (-words[v], v), default=None)
        if form is not None and words[form] < 2 * n:
            form = None
        out[w] = (n, len(beside), form, words.get(form))

    def root(w):
        return w if out[w][2] is None else root(out[w][2])

    return {(w, *v, root(w)) for w, v in out.items()}


def test_variants_equal_plain_python_and_sql(docs):
    rows = rows_of(150, 3) + ODD * 2
    got = spelling.group_variants(docs)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    found = {tuple(r) for r in got.collect()}
    assert found == plain_variants(rows)
    assert sum(r[3] is not None for r in found) > 20 and any(r[2] > 1 for r in found)
    same(got, by_sql(oracle.VARIANTS, rows))


def test_chains_of_forms_end_at_the_root(spark):
    words = [("aaaaa", 100), ("aaaab", 50), ("aaabb", 25), ("aabbb", 12), ("abbbb", 6), ("bbbbb", 3), ("zzzzz", 3), ("aaaaaa", 3)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {got[w].root for w in ("aaaaa", "aaaab", "abbbb", "bbbbb", "aaaaaa")} == {"aaaaa"}
    assert got["zzzzz"].root == "zzzzz" and got["zzzzz"].form is None and got["zzzzz"].n_near == 0
    # deleting any letter of aaaaaa gives aaaaa: one near word, not six
    assert got["aaaaaa"].n_near == 1 and got["aaaaa"].n_near == 2


@pytest.mark.parametrize("hot", [False, True])
def test_no_table_of_words_is_broadcast(spark, monkeypatch, hot):
    """However small Spark takes them to be; each table that is written counts, and the result. Only marks of hot keys are."""
    plans = []
    cut = spelling.written
    monkeypatch.setattr(spelling, "written", lambda df, what: (plans.append(df), cut(df, what))[1])
    if not hot:
        monkeypatch.setattr(spelling, "heavy", lambda *_: None)
    words = [("aaaaa", 100), ("aaaab", 50), ("aaabb", 25), ("aabbb", 12), ("aaaaaa", 3)]
    out = spelling.variants(spark.createDataFrame(words, "word string, n long"))
    assert {r.root for r in out.collect()} == {"aaaaa"}
    assert len(plans) > 3
    for df in (*plans, out):
        joins = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in line]
        assert len(joins) in (0, 2 * hot) and not any("_piece" in line for line in joins)


def test_ties_go_to_the_first_word(spark):
    words = [("abcde", 1), ("abcdf", 9), ("abcdé", 9), ("abcdz", 9), ("xbcde", 9)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["abcde"].form == "abcdf" and got["abcde"].n_near == 4
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(words, "word string, n long"), times=1)


def test_a_group_of_every_letter_and_many_words_of_one_root(spark):
    letters = [chr(x) for x in [*range(97, 123), *range(0xC0, 0x100)]]
    words = [("base" + x, 3) for x in letters if x != "q"] + [("baseq", 500)]
    got = spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()
    assert {(r.n_near, r.root) for r in got} == {(len(letters) - 1, "baseq")}


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 7)
    text = "lettersandmore WORDSTOO naïveté × ÷ßı " * 50
    whole = Counter()
    for run in re.findall("[A-Za-zÀ-ÿ]+", text):
        whole["".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)] += 1
    parts = Counter()
    for part in spelling._stretches(text):
        parts.update(w.decode("latin-1") for w in part.encode("latin-1", "replace").translate(spelling._FOLD).split())
    assert parts == whole
    one = spark.createDataFrame([(1, "q" * 3_000_000 + " " + "tests " * 500_000)], "doc_id long, text string")
    got = {r.word: r.n for r in spelling.count_words(one).collect()}
    assert got == {"tests": 500_000}


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.group_variants(empty).count() == 0
    clash = spark.createDataFrame([(1, "words words words", "x", 1)], "doc_id long, text string, word string, n long")
    assert [tuple(r) for r in spelling.group_variants(clash).collect()] == [("words", 3, 0, None, None, "words")]


# ---- op12 --------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Independent of the operator: lists, level by level."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t)
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = H(*map(field, (doc_id, source, lang, n_chars, text)))
        bad = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            bad = H(*map(field, (doc_id, source, lang, n_chars, None if text is None else lower(text))))
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id, bad))

    def build(level):
        levels = [level]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([H(*below[i : i + 8]) for i in range(0, len(below), 8)])
        return levels

    def climb(levels, at, digest):
        beside = ""
        for below in levels[:-1]:
            run = below[at // 8 * 8 : at // 8 * 8 + 8]
            i = at % 8
            beside += "".join(run[:i] + run[i + 1 :])
            digest, at = H(*run[:i], digest, *run[i + 1 :]), at // 8
        return digest, beside

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: build([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = build([trees[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for at, g in enumerate(names):
        for i, (_, _, leaf, doc_id, bad) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            cur, beside = climb(trees[g], i, bad)
            end, more = climb(top, at, cur)
            out.append((doc_id, leaf, trees[g][-1][0], root, H(beside + more), end, end == root))
    return Counter(out)


def test_manifest_equals_plain_python_and_sql(docs):
    rows = rows_of(150, 3) + ODD * 2
    got = manifest.verify_documents(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == plain_manifest(rows)
    same(got, by_sql(oracle.manifest_sql(), rows))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 73])
def test_trees_of_every_shape(spark, n):
    """One language of n rows, and then n languages: lone leaves, full runs, last runs of one."""
    one = [(i, f"Text {i}", "en", "s", i) for i in range(n)]
    many = [(i, f"Text {i}", f"l{i:03d}", "s", i) for i in range(n)]
    for rows in (one, many):
        got = manifest.verify_documents(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert Counter(tuple(r) for r in got.collect()) == plain_manifest(rows)


def test_manifest_finds_what_changed_only(docs):
    got = {r.doc_id: r for r in manifest.verify_documents(docs).where("doc_id < 150").collect()}
    texts = {r[0]: r[1] for r in rows_of(150, 3)}
    for i, text in texts.items():
        changed = zlib.crc32(str(i).encode()) % 3 == 0 and re.search("[A-Z]", text)
        assert got[i].verified == (not changed)


def test_manifest_of_nothing_and_of_a_wide_table(spark):
    assert manifest.verify_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame([(1, "A" * 2_000_000, "en", "s", 1, "p", "g")], SCHEMA + ", path string, leaf string")
    row = manifest.verify_documents(wide).collect()[0]
    assert row.leaf == row.subroot == row.root == H("1:1", "1:s", "2:en", "1:1", "2000000:" + "A" * 2_000_000) and row.proof_sha256 == H()


# ---- op13 --------------------------------------------------------------------------------------


def plain_rules(rows, min_docs, min_share, min_left=0.5):
    space = re.compile(r"[\x20\x09-\x0D]+")
    norm = lambda line: space.sub(" ", re.sub("[0-9]", "0", line.lower())).strip(" ")
    held, texts = defaultdict(set), defaultdict(set)
    lines_of = lambda t: [x for x in (t or "").split("\n") if space.sub("", x)]
    for _, text, _, host, _ in rows:
        texts[host].add(text or "")
        for line in lines_of(text):
            held[host, norm(line)].add(text)
    out = []
    for doc_id, text, _, host, _ in rows:
        words = [w for w in space.split(text or "") if w]
        lines = lines_of(text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        gone = sum(len(space.sub("", x)) for x in lines if len(held[host, norm(x)]) > min_docs and len(held[host, norm(x)]) > min_share * len(texts[host]))
        chars = sum(map(len, words))
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        out.append((doc_id, len(words), chars, sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(hit), gone, failed, not failed and chars - gone >= chars * min_left))
    return Counter(out)


@pytest.mark.parametrize("min_docs,min_share", [(10, 0.01), (3, 0.3), (0, 0.0)])
def test_rules_equal_plain_python_and_sql(docs, min_docs, min_share):
    rows = rows_of(150, 3) + ODD * 2
    got = line_rules.judge(docs, min_docs=min_docs, min_share=min_share)
    found = Counter(tuple(r) for r in got.collect())
    assert found == plain_rules(rows, min_docs, min_share)
    assert any(r[6] for r in found) and any(r[5] for r in found) and any(r[8] for r in found) == (min_docs > 0)
    same(got, by_sql(oracle.line_rules_sql(min_docs, min_share), rows))


def test_depleted_documents_go_and_copies_count_once(spark):
    menu = "home news contact imprint login search sitemap help about terms"
    own = lambda i: " ".join(f"{i}{x}".translate(str.maketrans("0123456789", "abcdefghij")) for x in "klmnopqrstuv")
    full = [(i, f"{menu}\n{own(i)}\n{own(i + 500)}", "en", "h", 1) for i in range(30)]
    bare = [(100 + i, f"{menu}\n  {menu.upper()} \n{'abcde'[i]}", "en", "h", 1) for i in range(5)]
    copies = [(200 + i, own(9999), "en", "h", 1) for i in range(40)]
    elsewhere = [(300, f"{menu}\n{menu}", "en", "other", 1), (301, menu, "en", None, 1)]
    kept = {r.doc_id for r in line_rules.judge(spark.createDataFrame(full + bare + copies + elsewhere, SCHEMA)).where("kept").collect()}
    assert kept == {r[0] for r in full + copies} | {301}


def test_rules_of_nothing_of_wide_tables_and_long_texts(spark):
    assert line_rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long, "en", "s", 1, "a", "b"), (2, long + " w0 w1 w2 w3 w4", "en", "s", 1, "a", "b"), (3, "a " * 500_000, "en", "s", 1, "a", "b")]
    got = {r.doc_id: r for r in line_rules.judge(spark.createDataFrame(rows, SCHEMA + ", row string, copy string")).collect()}
    assert got[1].n_repeat_words == 0 and got[1].kept and got[2].n_repeat_words == 10 and got[2].kept
    assert got[3].n_words == got[3].n_repeat_words == 500_000 and got[3].base_failed


def test_frequent_lines_by_shuffle_are_the_same(docs, monkeypatch):
    small = Counter(tuple(r) for r in line_rules.judge(docs, min_docs=2).collect())
    monkeypatch.setattr(line_rules, "MOST_BROADCAST", 0)
    assert Counter(tuple(r) for r in line_rules.judge(docs, min_docs=2).collect()) == small


def test_no_python_on_the_rules_path(docs):
    plan = line_rules.judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
