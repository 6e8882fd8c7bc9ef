import datetime
import functools
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import sequences as L
from palimpsest.functions import text as T
from palimpsest.functions import tokens as K
from palimpsest.functions.code import block_keystrokes, code_equal, keystrokes, normalized
from palimpsest.functions.diff import line_diffs
from palimpsest.functions.distance import edit_distance, levenshtein, within_band
from palimpsest.operators import changes as C
from palimpsest.operators import delta as D
from palimpsest.operators import evaluation as E
from palimpsest.operators import problems as Q
from palimpsest.operators import retrieval as R
from palimpsest.operators import scopes as P
from palimpsest.operators import stats as S
from palimpsest.plans import changes as plans
from palimpsest.plans import curation
from palimpsest.plans import stats as plan_stats
from palimpsest.plans import tokens as token_plans
from palimpsest.sources import history as H
from palimpsest.streaming import online as O


def test_lines(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\n\nb",), (None,)], "t string")
    rows = df.select(T.splitlines(F.col("t")).alias("l"), T.count_lines(F.col("t")).alias("n")).collect()
    assert [r.l for r in rows[:4]] == [[], ["a"], ["a", ""], ["a", "", "b"]]
    assert [r.n for r in rows] == [0, 1, 2, 3, None]
    assert spark.range(1).select(T.show_count(F.lit(999)), T.show_count(F.lit(1234)), T.short(F.lit("x" * 30)), T.module_name(F.lit("src/a/__init__.py"))).first()[:] == ("999", "1.2k", "x" * 27 + "...", "a")


def test_line_diffs_rebuild_both_sides():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.choice(["alpha", "alphb", "beta", "", "gamma one", "gamma two"]) for _ in range(rng.randrange(7))] for _ in range(2))
        rows = line_diffs(a, b)
        assert [r[2:] for r in rows if r[0] != "+"] == a
        assert [r[2:] for r in rows if r[0] != "-"] == b


def test_delta_laws(spark):
    """Apply, read back, decompose and group against a plain Python model."""
    rng = random.Random(5)
    texts, script = [], []
    for i in range(60):
        n = rng.randrange(0, 8)
        texts += [(i, k, f"t{k}") for k in range(n)]
        for k in range(n + 1):
            acts = [("+", f"a{k}.{j}") for j in range(rng.choice([0, 0, 0, 1, 2]))]
            if k < n and rng.random() < 0.4:
                acts.append(("-", ""))
            script += [(i, k, j, op, t) for j, (op, t) in enumerate(acts)]
    first = {s[:3]: rng.random() < 0.5 for s in script}
    lines = spark.createDataFrame(texts, "id long, line int, text string")
    delta = spark.createDataFrame(script, "id long, line int, act int, op string, text string")

    def applied(base, acts):
        """Inline diff of [(tag, text)] with acts {line: [(op, text)]} over its places; deletes mark."""
        out = []
        for k in range(len(base) + 1):
            ops = acts.get(k, [])
            out += [("+", t) for op, t in ops if op == "+"]
            if k < len(base):
                gone = any(op == "-" for op, _ in ops)
                out.append(("-" if gone else base[k][0], base[k][1]))
        return out

    def by_line(rows, at):
        acts = {}
        for r in sorted(rows, key=lambda r: (r["line"], r["act"])):
            acts.setdefault(r[at], []).append((r["op"], r["text"]))
        return acts

    got = {}
    for r in D.positions(D.apply_to_change(lines, delta)).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["tag"], r["text"]))
    for i in got:
        base = [(" ", t) for d, _, t in texts if d == i]
        assert got[i] == applied(base, by_line([dict(zip(("id", "line", "act", "op", "text"), s)) for s in script if s[0] == i], "line"))
    back = D.delta_of_diff(D.positions(D.apply_to_change(lines, delta)))
    assert sorted(map(tuple, back.select("id", "line", "act", "op", "text").collect())) == sorted(script)
    marked = delta.join(spark.createDataFrame([(*k, v) for k, v in first.items()], "id long, line int, act int, first boolean"), ["id", "line", "act"])
    for how in (D.decompose_for_change, D.decompose_for_input):
        rows = [r.asDict() for r in how(marked).collect()]
        for i in got:
            mine = [r for r in rows if r["id"] == i]
            base = [(" ", t) for d, _, t in texts if d == i]
            one = applied(base, by_line([r for r in mine if r["first"]], "line"))
            if how is D.decompose_for_input:
                one = [(" ", t) for tag, t in one if tag != "-"]
            two = applied(one, by_line([r for r in mine if not r["first"]], "new_line"))
            if how is D.decompose_for_change:
                assert [t for tag, t in two if tag != "-"] == [t for tag, t in got[i] if tag != "-"]
            elif all(not (r["op"] == "-" and r["first"]) for r in mine):
                assert [t for tag, t in two if tag != "-"] == [t for tag, t in got[i] if tag != "-"]
    groups = D.change_groups(delta)
    assert groups.count() == len(script)


def test_delta_of_empty(spark):
    lines = spark.createDataFrame([], "id long, line int, text string")
    delta = spark.createDataFrame([], "id long, line int, act int, op string, text string")
    assert D.apply_to_input(lines, delta).count() == 0 and D.change_groups(delta).count() == 0


def test_changes(spark):
    v = spark.createDataFrame([("p", "a", 0, "x"), ("p", "a", 1, "x"), ("p", "a", 2, None), ("p", "b", 5, "y")], "project string, path string, seq long, content string")
    rows = C.version_changes(v).orderBy("path", "seq").collect()
    assert [(r.kind, r.unchanged) for r in rows] == [("A", False), ("M", True), ("D", False), ("A", False)]
    turned = C.inverse(C.inverse(C.version_changes(v)))
    assert sorted(map(str, turned.collect())) == sorted(map(str, C.version_changes(v).select(*turned.columns).collect()))


def test_code():
    assert normalized('def f():\n  "doc"\n  g(b=1, a=2)') == normalized("def f():\n    g(a=2, b=1)")
    assert normalized("def (") == "def ("
    assert normalized("f(g(b=1, a=2))") != normalized("f(g(a=2, b=1))") and normalized("f(b=g(d=1, c=2), a=0)") == normalized("f(a=0, b=g(d=1, c=2))")
    assert [keystrokes(a, b) for a, b in (("", ""), ("abc", "abc"), ("", "abc"), ("abc", ""), ("abc", "axc"), ("a" * 100, ""))] == [0, 0, 7, 7, 6, 10]


def by_turn(spark, tmp_path, query, texts):
    """Rows by turn of a query over one conversation of these texts."""
    rows = [(1, k, "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return {r.turn: r for r in query(spark, str(tmp_path)).collect()}


def test_levenshtein_gain_of_whole_texts(spark, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
        return row[-1]

    rng = random.Random(7)
    texts = ["".join(rng.choice("abc é\n") for _ in range(rng.randrange(250, 400))) for _ in range(6)]
    texts += ["a" * 300 + "é", "a" * 300 + "e", "", "日本"]
    got = by_turn(spark, tmp_path, plans.levenshtein_gain, texts)
    assert {k: r.gain for k, r in got.items()} == {k: distance(texts[k - 1], texts[k]) for k in range(1, len(texts))}


def typed(a, b, jump=4):
    """Keystrokes by the rules, cell by cell."""

    @functools.cache
    def cost(i, j, c, gone):
        if i < 0 or j < 0:
            return 10**6
        if i == j == 0 and not gone:
            return 0
        far = min(c + 1, jump)
        if gone:
            return min(cost(i - 1, j, far, True), 1 + c + cost(i, j, 0, False) if c else 10**6)
        least = min(cost(i - 1, j, 0, False), cost(i, j - 1, 0, False), cost(i, j, 0, True)) + 1 + c
        return min(least, cost(i - 1, j - 1, far, False)) if i and j and a[-i] == b[-j] else least

    return cost(len(a), len(b), jump, False)


def test_block_keystrokes():
    cases = {("", ""): 0, ("abc", "abc"): 0, ("", "abc"): 7, ("abc", ""): 7, ("abc", "abcd"): 5, ("abc", "aabc"): 5, ("abc", "axc"): 6, ("abc", "axdf"): 9, ("abc", "xaxbc"): 7, ("abcdefg", "axbcdefxg"): 10, ("abcdefg", "xaxbxcxdxefg"): 13, ("abcdefg", "xbxdxfx"): 15, ("abcdefg", "axxxxfg"): 12, ("abcde", "acde"): 5, ("a" * 100, ""): 10, ("a" * 30 + "b" * 20 + "c" * 30, "a" * 30 + "c" * 30): 10}
    assert block_keystrokes(list(cases)) == list(cases.values())
    rng = random.Random(8)
    pairs = [tuple("".join(rng.choice("abé\n") for _ in range(rng.randrange(25))) for _ in range(2)) for _ in range(300)]
    assert block_keystrokes(pairs) == [typed(a, b) for a, b in pairs]
    assert block_keystrokes([("x" * 4000, "y" * 3500), ("a", "b")]) == [block_keystrokes([("x" * 4000, "y" * 3500)])[0], 6]


def test_keystroke_gain_of_whole_texts(spark, tmp_path):
    long = "x" * 60
    texts = ["one\ntwo\nthree", "one\nzwei\nthree", "one\nzwei", "one\nzwei\nfour\nfive", long + "a\nend", long + "b\nend", long + "b\nend"]
    got = by_turn(spark, tmp_path, plans.keystroke_gain, texts)
    assert [got[k].keystrokes for k in (1, 2, 3, 5, 6)] == [typed("two", "zwei"), 2 + 4, 9 + 4, typed(long + "a", long + "b"), 0]
    assert got[4].keystrokes == typed(texts[3], texts[4])


def test_whole_messages_count(spark, tmp_path):
    """Texts that share first letters, or their first three turns, are not the same."""
    talks = [["a b", "c", "d"], ["a x", "c", "d"], ["a b", "c", "d"], ["a b", "c", "d", "e"], ["Yes", "yes", "yet"]]
    rows = [(i, k, "user", t) for i, talk in enumerate(talks) for k, t in enumerate(talk)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted((r.conv_id, r.n) for r in curation.repo_signature_dedupe(spark, str(tmp_path)).collect()) == [(0, 2), (1, 1), (3, 1), (4, 1)]
    forms = {(r.form, r.n_samples) for r in plan_stats.marginalize(spark, str(tmp_path)).where("conv_id = 4").collect()}
    assert forms == {("yes", 2), ("yet", 1)}


def test_code_too_deep_for_the_parser():
    """The parser's MemoryError and RecursionError are texts that do not parse, not a failed task."""
    overflow, deep = "a " + "not " * 9000 + "b", "x." * 20000 + "x"
    for code in (overflow, deep, "x\0"):
        assert normalized(code) == code and not Q.parses(code)
        assert P.spans_of(code) == [] and P.imports_of("m", code) == [] and P.usages_of("m", code) == []
    assert normalized("-" * 1500 + "1") == normalized("- " * 1500 + "1")


def test_levenshtein_against_the_table(spark):
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    rng = random.Random(11)
    pairs = [("", ""), ("", "ab"), ("ab", "ab"), ("é😀b", "😀be")]
    for _ in range(300):
        a, b = ("".join(rng.choice("abc😀") for _ in range(rng.randrange(30))) for _ in range(2))
        pairs += [(a, b), (a, "".join(c for c in a if rng.random() < 0.8) + rng.choice(["", "ab"]))]
    assert [levenshtein(a, b) for a, b in pairs] == [table(a, b) for a, b in pairs]
    # bands too narrow for the distance never give less
    for a, b in pairs:
        if 0 < len(b) <= len(a):
            for slack in range(4):
                low, high = min(slack, len(b)), min(len(a) - len(b) + slack, len(a) - 1)
                got, d = within_band(a, b, low, high), table(a, b)
                assert got >= d and (got == d or d > len(a) - len(b) + 2 * slack + 1)
    # texts of many words of bits, and distances beyond the first band
    words = [rng.choice(["lorem ", "ipsum ", "dolor ", "sit\n"]) for _ in range(400)]
    long = ["".join(words), "".join(w for k, w in enumerate(words) if k % 7), "".join(rng.sample(words, 300))]
    rows = spark.createDataFrame([(a, b) for a in long for b in [*long, None]], "a string, b string")
    assert all(r.x == r.y for r in rows.select(F.levenshtein("a", "b").alias("x"), edit_distance("a", "b").alias("y")).collect())
    # 120,000 characters with every seventh line gone: 10 ** 10 cells of a table
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(400)]
    assert levenshtein("\n".join(lines), "\n".join(x for k, x in enumerate(lines) if k % 7 != 3)) == 301 * 57


def test_code_equal(spark):
    df = spark.createDataFrame([("f(a=1,b=2)", "f(b=2, a=1)"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(code_equal(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_scopes(spark):
    code = "import a\nX = 1\nY = 2\n\n@d\ndef f(x):\n    return X\n\nclass K:\n    z = 1\n    async def m(self):\n        return self.z\n"
    assert [(p, k, a, b) for p, k, _, a, b, _ in P.spans_of(code)] == [("", "statements", 2, 4), ("f", "header", 5, 7), ("f", "body", 7, 8), ("K", "header", 9, 10), ("K", "statements", 10, 11), ("K.m", "header", 11, 12), ("K.m", "body", 12, 13)]
    assert P.usages_of("m", code) == [(7, "m.X"), (12, "m.K.z")]
    assert P.module_order([("a", "b"), ("b", "c"), ("c", "a")], ["a", "b", "c"]) == ["c", "b", "a"]
    assert P.imports_of("p.q", "from . import r\nimport s.t") == ["p", "p.r", "s.t"]


def test_retrieval(spark):
    tokens = F.split(F.lit("x <1> a b <2> <1> c"), " ")
    assert [(r["mark"], r["tokens"]) for r in spark.range(1).select(R.output_segments(tokens)).first()[0]] == [("<2>", []), ("<1>", ["c"])]
    chunks = spark.range(1).select(R.chunked(F.sequence(F.lit(1), F.lit(10)), 4, 1)).first()[0]
    assert chunks == [[1, 2, 3, 4], [4, 5, 6, 7], [7, 8, 9, 10]]


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "key long, v double")
    r = S.bootstrap_interval(df, "v", rounds=400).first()
    assert 0.43 < r.low < 0.5 < r.high < 0.57
    pairs = df.select("key", (F.col("v") + 1).alias("a"), F.col("v").alias("b"))
    assert S.bootstrap_compare(pairs, "a", "b", rounds=50).first().p == 1.0


@pytest.mark.parametrize("late", [False, True])
def test_latest_request_stream_is_the_batch_rule(spark, tmp_path, late):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(k % 3, t0 + datetime.timedelta(minutes=(k * 7) % 11 if late else k), k) for k in range(30)]
    schema = "project long, ts timestamp, seq long"
    for n in range(3):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = O.latest_requests_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = O.latest_requests(spark.createDataFrame(rows, schema)).select("seq", "status")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("seq", "status").collect())) == sorted(map(tuple, want.collect()))


def test_git_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ("x = 1\n", "x = 2\n"):
        (tmp_path / "m.py").write_text(text)
        git("add", "."), git("commit", "-qm", text.strip())
    (tmp_path / "grün x.py").write_text("y = 1\n")
    git("checkout", "-qb", "side", "HEAD~1"), git("add", "grün x.py"), git("commit", "-qm", "side")
    git("checkout", "-q", "-"), git("merge", "-q", "--no-ff", "-m", "merged", "side")
    merged = H.commits(spark, [str(tmp_path)])
    # at a merge the history goes on with what was merged in
    assert [r.message for r in merged.orderBy("seq").collect()] == ["x = 1", "side", "merged"]
    assert ("grün x.py", 1, "y = 1\n") in {(r.path, r.seq, r.content) for r in H.file_versions(merged).collect()}
    git("reset", "-q", "--hard", "HEAD~1")
    found = H.commits(spark, [str(tmp_path), str(tmp_path / "none")])
    assert [r.message for r in found.orderBy("seq").collect()] == ["x = 1", "x = 2"]
    assert [(r.path, r.seq, r.content) for r in H.file_versions(found).orderBy("seq").collect()] == [("m.py", 0, "x = 1\n"), ("m.py", 1, "x = 2\n")]
    H.save(found, str(tmp_path / "saved"), "seq")
    assert H.load(spark, str(tmp_path / "saved"), seq=1).count() == 1


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def words(*tokens):
    return F.array(*map(F.lit, tokens)) if tokens else K.none()


def test_text_scalars(spark):
    a = F.array(*map(F.lit, "abc"))
    assert one(spark, T.interleaved(a, F.array(F.lit("-"), F.lit("+")))) == "a-b+c" and one(spark, T.interleaved(a, F.array(F.lit("-")))) is None
    assert one(spark, T.lines_of(a)) == "a\nb\nc\n" and one(spark, T.dotted(F.lit("a.b"))) == ["a", "b"]
    assert one(spark, T.code_range(F.lit(3), F.lit(0), F.lit(4), F.lit(7))) == "[3:1--4:8]"
    assert one(spark, T.valid_range(F.lit(3), F.lit(2))) is None and one(spark, T.valid_range(F.lit(2), F.lit(2))) == (2, 2)
    both = T.merged([F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))])
    assert one(spark, both) == {"a": 1, "b": 3} and one(spark, T.picked(both, F.array(F.lit("b")))) == {"b": 3}
    assert one(spark, T.added_up(both, F.create_map(F.lit("c"), F.lit(5), F.lit("b"), F.lit(1)))) == {"a": 1, "b": 4, "c": 5}
    assert one(spark, T.is_sorted(F.array(F.lit(1), F.lit(1), F.lit(2)))) and not one(spark, T.is_sorted(F.array(F.lit(2), F.lit(1))))
    edits = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(u).alias("until"), F.lit(p).alias("priority"), F.lit(t).alias("new")) for s, u, p, t in ((6, 11, 0, "there"), (0, 0, 1, "B"), (0, 0, 0, "A"))))
    assert one(spark, T.replaced_at(F.lit("hello world!"), edits)) == "ABhello there!"
    assert one(spark, T.shown_change(F.lit("A"), F.lit("f"), F.lit(None), F.lit("x\ny"), F.lit(None))) == "Added: f\n  x\n  y"


def test_tokens(spark):
    for text in ("", "a", "a b\n\n  c(1)\n", "\n"):
        assert one(spark, K.decode(K.encode(F.lit(text)))) == text
    assert one(spark, K.parted(words("a", K.NL, K.NL, "b", K.NL))) == [["a"], [], ["b"], []] and one(spark, K.parted(words())) == []
    assert one(spark, K.line_range(words("a", K.NL, "b", K.NL, "c"), F.lit(1), F.lit(9))) == ["b", K.NL, "c"]
    out = words("x", "<1>", K.ADD, "a", K.NL, "<0>", K.DEL, "<1>", "z", K.PAD)
    assert [tuple(r) for r in one(spark, K.segments(out))] == [("<0>", [K.DEL]), ("<1>", ["z"])]
    diff = words(K.ADD, "n", K.NL, K.DEL, "o", K.NL, "k", K.NL, K.ADD, "e")
    io = one(spark, K.input_output(diff))
    assert io.input == ["<0>", "o", K.NL, "<1>", "k", K.NL, "<2>"] and io.output == ["<0>", K.ADD, "n", K.NL, K.DEL, "<1>", "<2>", K.ADD, "e", K.NL]
    back = one(spark, K.inlined(F.array(*map(F.lit, io.input)), F.array(*map(F.lit, io.output))))
    assert back == [K.ADD, "n", K.NL, K.DEL, "o", K.NL, "k", K.NL, K.ADD, "e", K.NL]
    assert tuple(one(spark, K.change_of(diff))) == ("o\nk", "n\nk\ne")
    d = one(spark, K.delta_of(diff))
    assert d.original == ["o", K.NL, "k"] and d.delta == {0: [[K.ADD, "n"], [K.DEL]], 2: [[K.ADD, "e"]]}
    given = K.delta_of_output(F.array(F.lit(4), F.lit(7)), words("<9>", "drop", K.ADD, "n", K.NL, K.DEL, "<3>", "<5>", K.ADD, "x"))
    assert one(spark, given) == {4: [[K.ADD, "n"], [K.DEL]]}
    assert not one(spark, K.valid_output(words("<0>", K.DEL, "x"))) and one(spark, K.valid_output(words("<0>", K.DEL, "<1>")))
    assert not one(spark, K.marks_known(words("<0>"), words("<1>"))) and one(spark, K.small_edit(words(K.ADD, K.DEL), 2))
    assert one(spark, K.without_unknown(words("<1>", "<0>"), words("<0>", "a", "<2>", "c", "<1>", "b"))) == ["<1>", "b", "<0>", "a"]
    turned = one(spark, K.renumbered(F.array(*(F.lit(f"<{i}>") for i in range(100)), F.lit("x")), F.lit(5)))
    assert sorted(turned[:100]) == sorted(f"<{i}>" for i in range(100)) and turned[:100] != [f"<{i}>" for i in range(100)] and turned[100] == "x"
    assert one(spark, K.compressed(words("a", K.NL, "b", K.NL, K.ADD, "c", K.NL, "d", K.NL, "e", K.NL, "f"), 1)) == [".", ".", ".", K.NL, "b", K.NL, K.ADD, "c", K.NL, "d", K.NL, ".", ".", "."]
    assert one(spark, K.truncated(words(*"abcde"), F.lit(3))) == ["a", "b", K.EOS] and one(spark, K.truncated(words(*"abcde"), F.lit(3), keep_end=True)) == [K.BOS, "d", "e"]
    assert one(spark, K.padded(F.array(words("a"), words("a", "b")))) == [["a", K.PAD], ["a", "b"]] and one(spark, K.round_up(F.lit(65))) == 128
    assert one(spark, K.header_tokens(F.array(words("h")), F.lit(3), 50)) == ["h", K.NL, "#", " ", "offset", ":", " ", "3", K.NL]


def test_lists_follow_the_rules_of_expressions(spark):
    """Diffs with adds first, last and in runs, empty lines, more lines than marks, and marks in the text."""
    rng = random.Random(23)
    diffs = [[" x"], ["+a"], ["-a"], [" ", "+", "- "], ["+a", "+b", "-c", "+d"], [" <5> <nl>", "-<5>", "+<del> <7>"], [f"{' +-'[k % 3]}w {k}" for k in range(320)]]
    diffs += [[rng.choice("  +-") + rng.choice(["", "a b", "(c)", "é😀", "<3>"]) for _ in range(rng.randrange(2, 12))] for _ in range(40)]
    t = spark.createDataFrame([(k, d) for k, d in enumerate(diffs)], "k int, d array<string>").select("k", K.encode_diff(F.col("d")).alias("t"))
    t = t.select("*", K.input_output(F.col("t")).alias("io"), K.delta_of(F.col("t")).alias("e"))
    io, e = ("io.input", "io.output"), ("e.original", "e.delta")
    t = t.select("*", K.edit_of(*map(F.col, io)).alias("c"), K.change_of(F.col("t")).alias("was"), K.valid_output(F.col(io[1])).alias("valid"), K.marks_known(*map(F.col, io)).alias("known"), K.applied(*map(F.col, e)).alias("both"), K.applied(*map(F.col, e), keep_deleted=False).alias("new"))
    for r in t.collect():
        tokens = L.encode_diff(diffs[r.k])
        assert tokens == r.t and L.change_of(tokens) == tuple(r.was)
        source, output = L.input_output(tokens)
        assert (source, output) == tuple(r.io) and L.change_of(L.inlined(source, output)) == tuple(r.c)
        assert (L.valid_output(output), L.marks_known(source, output)) == (r.valid, r.known)
        old, delta = L.delta_of(tokens)
        assert (old, delta) == tuple(r.e) and L.applied(old, delta) == r.both and L.applied(old, delta, keep_deleted=False) == r.new
    # what the rules demand, by hand: two adds and a delete of line 0, an add at the end
    assert L.input_output(L.encode_diff(diffs[4])) == (["<0>", "c", K.NL, "<1>"], ["<0>", K.ADD, "a", K.NL, K.ADD, "b", K.NL, K.DEL, "<1>", K.ADD, "d", K.NL])


def test_evaluation(spark):
    """The grouped delta functions against the relational ones, and a simulation by hand."""
    rng = random.Random(17)
    for _ in range(60):
        diff = [(" ", f"t{k}") for k in range(rng.randrange(1, 7))]
        edit = {}
        for k in range(len(diff) + 1):
            acts = [("+", f"a{k}.{j}") for j in range(rng.choice([0, 0, 1, 2]))] + ([("-", "")] if k < len(diff) and rng.random() < 0.4 else [])
            if acts:
                edit[k] = acts
        keys = {(k, j) for k, acts in edit.items() for j in range(len(acts)) if rng.random() < 0.5}
        two = E.put_in(E.put_in(diff, E.part_of(edit, keys)), E.rest_after(edit, keys))
        assert [t for tag, t in two if tag != "-"] == [t for tag, t in E.put_in(diff, edit) if tag != "-"]
        assert sorted(k for g in E.groups_of(edit) for k in g) == sorted((k, j) for k, acts in edit.items() for j in range(len(acts)))
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate("abcdef")], "id long, line int, text string")
    gold = spark.createDataFrame([(1, 0, 0, "+", "new"), (1, 0, 1, "-", ""), (1, 3, 0, "+", "bad"), (1, 5, 0, "-", "")], "id long, line int, act int, op string, text string")
    wrong = lambda diff, edit: {k: [(op, "?" if t == "bad" else t) for op, t in acts] for k, acts in edit.items()}
    got = {r.model: tuple(r)[2:] for r in E.multi_round(lines, gold, wrong).collect()}
    assert got["diff_lines"] == (4, 3, 3, 2)
    gains = E.edit_gains(lines, gold).first()
    # "d e f" becomes "bad d e" by four edits, "a" becomes "new" by three
    assert (gains.diff_lines, gains.levenshtein) == (4, 7)
    assert E.exact_matches(lines, gold, gold).first().correct and not E.exact_matches(lines, gold, gold.where("line < 5")).first().correct
    df = spark.createDataFrame([("a", k, float(c)) for k, c in enumerate([5, 5, 9, 20, 1, 1, 1])], "g string, k int, c double")
    assert [r.batch for r in E.dynamic_batches(df, "g", ["k"], F.col("c"), 10.0, 2).orderBy("k").collect()] == [0, 0, 1, 2, 3, 3, 4]
    rows = spark.createDataFrame([(0, "q1", ["r1", "r2"], "l1"), (0, "q2", ["r2", "r3"], "l2")], "b int, q string, r array<string>, l string")
    p = E.packed(rows, ["b"], "q", "r", "l").first()
    assert p.references == ["r1", "r2", "r3"] and p.reference_lists == [[0, 1], [1, 2]] and p.labels == ["l1", "l2"]


def test_rounds_of_one_model_cost_no_other(spark, monkeypatch):
    """A model that was not asked for is not computed, and asking for one changes no gain."""
    diff = [(" ", f"line {k % 3}") for k in range(40)]
    edit = {k: [("+", f"+ins {k}"), ("-", "")] if k % 4 == 0 else [("-", "")] for k in range(0, 40, 2)}
    both = {s: E.rounds_of(diff, edit, token_plans.guess, s, 6) for s in ("pick_first", "least_effort")}
    assert E.rounds_of(diff, edit, token_plans.guess, "least_effort", 6, ("keystrokes",)) == {"keystrokes": both["least_effort"]["keystrokes"]}
    # texts and deltas in no order, a text without a delta, a delta of a text without lines
    rows = [(i, k, t) for i in (1, 2) for k, (_, t) in enumerate(diff)]
    acts = [(1, k, j, *a) for k, x in edit.items() for j, a in enumerate(x)] + [(3, 0, 0, "+", "+ins 1")]
    lines = spark.createDataFrame(rows[::-1], "id long, line int, text string")
    delta = spark.createDataFrame(acts[::-1], "id long, line int, act int, op string, text string")
    got = {(r.id, r.model): tuple(r)[2:] for r in E.multi_round(lines, delta, lambda d, e: e).collect()}
    assert set(got) == {(i, m) for i in (1, 3) for m in E.MODELS} and got[1, "diff_lines"] == (30, 30, 30, 1) and got[3, "diff_lines"] == (1, 1, 1, 1)
    monkeypatch.setattr(E, "text_keystrokes", lambda pairs: pytest.fail("keystrokes were computed"))
    assert E.rounds_of(diff, edit, token_plans.guess, "pick_first", 6, ("diff_lines",)) == {"diff_lines": both["pick_first"]["diff_lines"]}


def test_changed_spans_of_modules(spark):
    before = "X = 1\n\ndef f(a):\n    return a\n\nclass K:\n    y = 2\n    def m(self):\n        return 1\n\ndef gone():\n    pass\n"
    after = "X = 1  # same\n\ndef f(a):\n    b = a\n    return b\n\nclass K:\n    y = 3\n    def m(self):\n        return 1\n\ndef added():\n    pass\n"
    rows = Q.spans_of_change(before, after)
    assert [(r[0], r[3]) for r in rows] == [("f", "M"), ("K", "M"), ("gone", "D"), ("added", "A")]
    assert rows[0][6:8] == ("    return a\n", "    b = a\n    return b\n") and rows[1][8] == ["class K:\n"]
    assert ("", "M") in [(r[0], r[3]) for r in Q.spans_of_change(before, after, syntax_only=False)]
    versions = spark.createDataFrame([("p", 0, "m", before), ("p", 1, "m", after), ("p", 2, "m", "def ("), ("p", 3, "m", None)], "project string, seq long, path string, content string")
    spans = Q.commit_spans(versions)
    kinds = {(r.seq, r.change, r.kind == "unparsed") for r in spans.collect()}
    assert (2, "M", True) in kinds and (3, "D", True) in kinds and (1, "M", False) in kinds
    found, context = Q.problems(spans)
    assert {(r.seq, r.path) for r in found.collect()} == {(1, "f"), (1, "K")}
    assert [(r.uid, r.item) for r in context.collect()] == [("m/K/statements/0", "m/f/body/0")]
    made = {r.uid: r for r in Q.tokenized(found, context, spans).collect()}
    assert made["m/K/statements/0"].header[:2] == ["class", " "] and len(made["m/K/statements/0"].references) == 1 and not made["m/f/body/0"].truncated
    assert "<add>" in made["m/f/body/0"].output and made["m/f/body/0"].input[0] == "<0>"
    assert Q.problem_stats(Q.tokenized(found, context, spans)).count() == 5
    order = Q.ordered_modules(spark.createDataFrame([("p", "a", "b")], "project string, src string, dst string"), spark.createDataFrame([("p", "a"), ("p", "b")], "project string, module string"))
    assert [r.module for r in order.orderBy("place").collect()] == ["b", "a"]
