import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import ids, paths, text, vectors
from graphloom.sources import files, gitlog


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("patch, want", [
    ("", []), ("@@ -5 +5 @@ f", [(5, 5)]), ("@@ -10,5 +12,7 @@ f", [(12, 18)]), ("@@ -3,2 +3,0 @@ f", []), ("@@ -1,3 +1,4 @@\n x\n@@ -20,2 +21,3 @@", [(1, 4), (21, 23)]), ("@@ -100 +100 @@ g", [(100, 100)]),
])
def test_hunks(spark, patch, want):
    assert [tuple(h) for h in one(spark, paths.hunks(F.col("p")), p=patch)] == want


def test_ids(spark):
    assert one(spark, ids.node_id(F.lit("function"), F.lit("a/b.C"))) == "function:a⋅b⋅C"
    assert one(spark, ids.package_of(F.lit("app.Foo.Bar"))) == "app" and one(spark, ids.package_of(F.lit(".x"))) is None and one(spark, ids.package_of(F.lit("x"))) is None
    assert one(spark, ids.suffix_of(F.lit("a.b.C"))) == ".C" and one(spark, ids.suffix_of(F.lit("C"))) == ".C"
    assert one(spark, ids.dotted_prefixes(F.lit("a.b.c"))) == ["a", "a.b"]
    assert one(spark, ids.capitalised(F.lit("svc"))) == "Svc" and one(spark, ids.capitalised(F.lit(""))) == ""
    kind, key = ids.split_id(F.lit("function:a:b"))
    assert one(spark, kind) == "function" and one(spark, key) == "a:b"


def test_text(spark):
    assert one(spark, text.code_tokens(F.lit("getUserID_élan"))) == ["get", "user", "id", "elan"]
    assert one(spark, text.ellipsis(F.lit("abcdef"), 3)) == "abc..." and one(spark, text.ellipsis(F.lit("abc"), 3)) == "abc"
    assert one(spark, text.count_lines(F.lit("a\nb\n"))) == 3
    assert one(spark, text.bare_signature(F.lit("F[T any, S[int]](a  T) [T]"))) == "F(a T)"
    body = "\n".join(f"l{k}" for k in range(10, 30))
    assert one(spark, text.excerpt(F.lit(body), F.lit(10), F.lit(12))) == "l10\nl11\nl12\nl13\nl14\nl15"
    assert one(spark, text.excerpt(F.lit(body), F.lit(10), F.lit(99))) is None
    assert one(spark, text.stems(F.array(F.lit("running"), F.lit("cities"), F.lit("hopefulness")))) == ["run", "citi", "hope"]
    a, b = text.word_set(F.lit("the Cat sat on")), text.word_set(F.lit("the cat ran"))
    assert one(spark, text.jaccard(a, b)) == 0.5


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.norm(v)) == 5.0 and one(spark, vectors.cosine(v, v)) == pytest.approx(1)
    assert one(spark, vectors.cosine(v, F.array(F.lit(0.0), F.lit(0.0)))) is None and one(spark, vectors.cosine(v, F.array(F.lit(1.0)))) is None
    assert one(spark, vectors.fit(v, 2)) == [3.0, 4.0] and one(spark, vectors.fit(v, 3)) == [0.6, 0.8, 0.0] and one(spark, vectors.fit(v, 1)) == [1.0]


@pytest.mark.parametrize("raw, url, slug", [
    ("git@h.io:o/r.git", "https://h.io/o/r", "o/r"), ("https://h.io/o/r.git", "https://h.io/o/r", "o/r"), ("https://h.io/o/r", "https://h.io/o/r", "o/r"), ("git@h.io:r.git", "https://h.io/r", ""), ("https://h.io/", "https://h.io/", ""),
])
def test_remotes(spark, raw, url, slug):
    assert one(spark, paths.remote_url(F.lit(raw))) == url and one(spark, paths.remote_slug(F.lit(raw))) == slug


def test_git_output(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    log = gitlog.parse_log(lines("h1|Ann|1700000000|fix a|b", "bad")).collect()
    assert [(r.hash, r.author, r.message) for r in log] == [("h1", "Ann", "fix a|b")]
    names = {r.path: (r.old_path, r.status) for r in gitlog.parse_name_status(lines("M\ta.go", "R100\told.go\tnew.go", "A\tb.go", "D\tc.go")).collect()}
    assert names == {"a.go": (None, "modified"), "new.go": ("old.go", "renamed"), "b.go": (None, "added"), "c.go": (None, "deleted")}
    counts = {r.path: (r.additions, r.deletions, r.status) for r in gitlog.parse_numstat(lines("3\t0\ta.go", "1\t2\tx/{old => new}/f.go", "-\t-\tbin")).collect()}
    assert counts == {"a.go": (3, 0, "added"), "x/new/f.go": (1, 2, "modified"), "bin": (0, 0, "modified")}
    patches = gitlog.split_patches(lines("diff --git a/x b/x\n@@ -1 +1 @@\n+y\ndiff --git a/z b/z\n" + "w" * 20_000)).collect()
    assert {r.path for r in patches} == {"x", "z"} and max(len(r.patch) for r in patches) == gitlog.PATCH_LIMIT + len(gitlog.PATCH_CUT)


def test_git_repository(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "."), run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    run("commit", "-qam", "two")
    commits = gitlog.list_commits(spark, str(tmp_path)).orderBy("n").collect()
    assert [c.message for c in commits] == ["one", "two"] or {c.message for c in commits} == {"one", "two"}
    row = gitlog.diff(spark, str(tmp_path), "HEAD~1", "HEAD").first()
    assert (row.path, row.status, row.additions, row.deletions) == ("a.py", "modified", 1, 0) and "+y = 2" in row.patch
    assert gitlog.diff_commit(spark, str(tmp_path), "HEAD").first().status == "added"
    assert gitlog.read_at(str(tmp_path), "HEAD~1", "a.py") == "x = 1\n" and gitlog.commit_info(spark, str(tmp_path), "HEAD").first().files == ["a.py"]


def test_walk(spark, tmp_path):
    for name, body in {"a.py": "x", "src/b.GO": "y", "vendor/c.go": "z", "src/d.txt": "t", "skip/e.py": "s", "go.mod": "module m.io/x\n\nrequire (\n\tq.io/y v1.2.3\n)\n", "big.py": "b" * 3000, ".gitignore": "skip/\n!no\n#c\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(body)
    got = files.walk(spark, str(tmp_path), max_file_kb=2)
    assert {(r.path, r.language) for r in got.collect()} == {("a.py", "python"), ("src/b.GO", "go"), ("go.mod", "gomod")}
    assert {r.path for r in files.walk(spark, str(tmp_path), ["go"], exclude=["*.GO"]).collect()} == {"go.mod"}
    mods = {r.qualified: r.docstring for r in files.go_mod_nodes(got, "r").collect()}
    assert mods == {"m.io/x": None, "q.io/y": "v1.2.3"}
    node = files.file_nodes(got.where("path = 'a.py'"), "r").first()
    assert node.node_id == "file:a⋅py" and len(node.content_hash) == 64 and node.end_line == 1


def test_schema(spark):
    row = spark.createDataFrame([("", "12a")], "a string, b string")
    assert tuple(schema.absent_as_null(row).first()) == (None, "12a")
    assert one(spark, schema.digits_as_int(F.lit("12a"))) == 12 and one(spark, schema.digits_as_int(F.lit("x"))) is None
    with pytest.raises(Exception, match="role is boss"):
        schema.require(spark.createDataFrame([("boss",)], "role string"), "role").collect()
    assert schema.conform(spark.createDataFrame([("x",)], "node_id string"), schema.NODES).columns[0] == "node_id"


def test_published_stems():
    words = "consigned consistency consolatory consolidating conspicuously conspirators constancy knackeries kneeling knightly knives knocker generously hoping hopping relational flies ties dying sky news".split()
    assert [text.stem(w) for w in words] == "consign consist consolatori consolid conspicu conspir constanc knackeri kneel knight knive knocker generous hope hop relat fli tie die sky news".split()
