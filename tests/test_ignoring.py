import fnmatch
import random

from pyspark.sql import functions as F

from verbatica.sources import ignoring


def fits(pattern, anchored, only, parts, is_folder):
    """One rule on the segments of a path, by hand."""
    segments = pattern.split("/")
    parts = parts if not only or is_folder else parts[:-1]
    if not parts:
        return False
    if not anchored and len(segments) == 1:
        return any(fnmatch.fnmatchcase(p, pattern) for p in parts)

    def walk(i, j):
        if j == len(segments):
            return True
        if segments[j] == "**":
            return walk(i, j + 1) or (i < len(parts) and walk(i + 1, j))
        return i < len(parts) and fnmatch.fnmatchcase(parts[i], segments[j]) and walk(i + 1, j + 1)

    return walk(0, 0)


def plainly(path, files):
    """Walks down to a path as a reader of folders does."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        is_folder, hit = n < len(parts), False
        for depth in range(n):
            for raw in files.get("/".join(parts[:depth]), "").splitlines():
                line = raw.strip()
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                line = line[keep:]
                anchored, only = line.startswith("/"), line.endswith("/")
                line = line.strip("/")
                if line and fits(line, anchored, only, parts[depth:n], is_folder):
                    hit = not keep
        if hit:
            return True
    return False


FILES = {"": "*.log\n!keep.log\nbuild/\n/docs/*.md\n# note\n\n**/tmp\na?c.[ch]\n", "en": "!*.log\nold*\n", "en/src": "data/**/x?.txt\n!build/\n/only\n", "de": "!build\n[!k]eep.log\n"}


def test_inherited_rules_equal_a_walk(spark):
    rng = random.Random(2)
    names = ["en", "de", "src", "build", "docs", "data", "tmp", "old1", "only", "deep"]
    leaves = ["a.log", "keep.log", "seep.log", "a.md", "abc.c", "abc.d", "x1.txt", "xx.txt", "only", "build", "tmp", "f(1)+.txt"]
    paths = sorted({"/".join([*rng.choices(names, k=rng.randint(0, 4)), rng.choice(leaves)]) for _ in range(900)})
    rows = spark.createDataFrame([(p,) for p in paths] + [(paths[0],), (None,)], "path string")
    out = {r.path: r.ignored for r in ignoring.ignored(rows, spark.createDataFrame(list(FILES.items()), "folder string, text string")).collect()}
    assert out == {p: plainly(p, FILES) for p in paths} and len(set(out.values())) == 2
    none = spark.createDataFrame([], "folder string, text string")
    assert not any(r.ignored for r in ignoring.ignored(rows, none).collect())


def test_lines_of_an_ignore_file():
    assert ignoring.rules("# no\n\n\\#x\n\\!y\n!z\n/\n  a/ \n") == [("(?:^|/)\\#x/", False, False), ("(?:^|/)\\!y/", False, False), ("(?:^|/)z/", False, True), ("(?:^|/)a/", True, False)]


def test_rule_files_of_a_tree(spark, tmp_path):
    for folder, text in FILES.items():
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / ".gitignore").write_text(text)
    (tmp_path / "en" / "x.txt").write_text("")
    assert {r.folder: r.text for r in ignoring.rule_files(spark, str(tmp_path)).collect()} == FILES


def test_projects_of_session_logs(spark):
    lines = [("/r/-home-a-proj/1.jsonl", '{"cwd": "/home/a/proj/"}'), ("/r/-home-a-proj/1.jsonl", "{}"), ("/r/-home-a-proj/2.jsonl", "{"), ("/r/-b-other/1.jsonl", "{}"), ("/r/plain/1.jsonl", "{}"), ("/r/-c-proj/1.jsonl", None), ("/r/-d/no.txt", "{}")]
    out = ignoring.session_projects(spark.createDataFrame(lines, "path string, value string"))
    assert {tuple(r) for r in out.collect()} == {("proj", "-home-a-proj", 2), ("other", "-b-other", 1)}
    assert out.where(F.col("name") == "plain").count() == 0
