import json
import os

import pytest

from textveil.cli import parse_args, run
from textveil.config import ScanConfig, parse_toml_subset
from textveil.errors import ConfigError, IoError, UsageError
from textveil.sources.files import binary_bytes, collect_files, list_files, read_documents, read_file
from textveil.operators.scan import MARKER
from textveil.sources.sinks import atomic_write

EMAIL = MARKER.format("EMAIL")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("mail me@post.example")
    (root / "sub/b.txt").write_text("plain words")
    (root / ".hidden").write_text("x")
    (root / "bin.dat").write_bytes(b"He\0l")
    (root / "bad.txt").write_bytes(b"ok \xff token=pk_live_geheim12345")
    os.symlink(root / "a.txt", root / "link")
    return root


def test_walk(tree):
    by = {os.path.basename(e.path): e for e in collect_files(str(tree))}
    assert {n for n, e in by.items() if e.eligible} == {"a.txt", "b.txt", "bin.dat", "bad.txt"}
    assert by[".hidden"].reason == "Hidden file/directory" and by["link"].reason == "Symlink (not following)"
    assert by["b.txt"].relative == "sub/b.txt"
    assert sum(e.eligible for e in collect_files(str(tree), include_hidden=True, follow_symlinks=True)) == 6
    assert {e.reason for e in collect_files(str(tree), max_file_size=4) if "max file" in (e.reason or "")} == {f"Exceeds max file size ({n} bytes)" for n in (20, 11, 30)}
    os.symlink("/etc", tree / "out")
    assert any("outside root" in (e.reason or "") for e in collect_files(str(tree), follow_symlinks=True))


def test_read_modes(spark, tree):
    listed = list_files(spark, str(tree))
    strict = {os.path.basename(r.path): (r.status, r.reason) for r in read_documents(listed).collect()}
    assert strict["a.txt"] == ("processed", None) and strict["bin.dat"] == ("skipped", "Binary file") and strict["bad.txt"][0] == "error"
    assert {r.status for r in read_documents(listed, "fail").collect() if r.path.endswith("bin.dat")} == {"error"}
    loose = {os.path.basename(r.path): r.text for r in read_documents(listed, "best-effort").collect()}
    assert loose["bad.txt"] == "ok \ufffd token=pk_live_geheim12345" and loose["bin.dat"] == "He\0l"
    with pytest.raises(IoError):
        read_file(str(tree / "a.txt"), 10)


def test_binary_rule():
    assert binary_bytes(b"He\0l") and not binary_bytes("Hello é\t\x1b".encode()) and not binary_bytes(b"")
    assert binary_bytes(b"\x01\x01ab") and not binary_bytes(b"\x01abc")


def test_toml():
    got = parse_toml_subset('# c\nreplacement = "[S]"\n[pattern]\nMY_ID = "ID-\\d+"\nq = "\n')
    assert got == {"replacement": "[S]", "pattern.MY_ID": "ID-\\d+", "pattern.q": '"'}
    with pytest.raises(ConfigError):
        parse_toml_subset("no equals")
    c = ScanConfig(max_file_size=5, explicit=frozenset({"max_file_size"}), allow=("A",)).with_file("max_file_size = 9\nbinary = odd\nallow_patterns = A, B\ninclude_hidden = true")
    assert (c.max_file_size, c.binary, c.allow, c.include_hidden) == (5, "skip", ("A", "B"), True)


def test_toml_lines_and_blanks():
    assert parse_toml_subset("a = 1\u2028b = 2\r\nc =\x1cd\u00a0\n") == {"a": "1\u2028b = 2", "c": "\x1cd"}


def test_report_escapes():
    from textveil.report import _json

    assert _json("\b\f\\b\n\x1f\"é") == '"\\u0008\\u000c\\\\b\\n\\u001f\\"é"'


def test_depth_and_other_kinds(tmp_path):
    deep = tmp_path / "a/b/c"
    deep.mkdir(parents=True)
    (deep / "x.txt").write_text("x")
    os.mkfifo(tmp_path / "pipe")
    got = [(e.path, e.reason) for e in collect_files(str(tmp_path), max_depth=2)]
    assert got == [(str(deep), "Max depth 2 exceeded")]
    assert [e.relative for e in collect_files(str(tmp_path), max_depth=3)] == ["a/b/c/x.txt"]


def test_files_below_a_uri(spark, tree, tmp_path, capsys):
    out = f"file://{tmp_path}/table"
    assert run(["--input", f"file://{tree}", "--output", out, "--max-file-size", "26", "--report-json"], spark) == 0
    files = {f["path"].split("/")[-1]: f for f in json.loads(capsys.readouterr().err)["files"]}
    assert {k: f["status"] for k, f in files.items()} == {"a.txt": "processed", "b.txt": "processed", "bin.dat": "skipped", "bad.txt": "skipped", "link": "processed"}
    assert files["bad.txt"]["reason"] == "Exceeds max file size (30 bytes)" and files["b.txt"]["path"] == "sub/b.txt"
    table = spark.read.parquet(out)
    assert {r.masked for r in table.collect()} == {f"mail {EMAIL}", "plain words"} and table.columns == ["path", "masked"]
    assert run(["--input", f"file://{tree}", "--in-place"], spark) == 2


def test_arguments():
    c = parse_args(["--text", "--summary", "--pattern", "A=b=c", "--allow-pattern", "X", "--allow-pattern", "Y", "--format", "json"])
    assert c.text == "--summary" and c.patterns == (("A", "b=c"),) and c.allow == ("X", "Y") and c.format == "json" and not c.summary
    for bad in (["--nope"], ["--text"], ["--format", "xml"], ["--pattern", "=x"], ["--max-file-size", "abc"]):
        with pytest.raises(UsageError):
            parse_args(bad)


def test_atomic_write(tmp_path):
    p = tmp_path / "d/x.txt"
    atomic_write(str(p), "one")
    os.chmod(p, 0o640)
    atomic_write(str(p), "two é")
    assert p.read_text() == "two é" and os.stat(p).st_mode & 0o777 == 0o640 and os.listdir(p.parent) == ["x.txt"]


def test_text_runs(spark, capsys):
    assert run(["--text", "mail me@post.example"], spark) == 0
    assert capsys.readouterr().out == f"mail {EMAIL}"
    assert run(["--text", "mail me@post.example", "--dry-run", "--fail-on-find"], spark) == 3
    got = capsys.readouterr()
    assert got.out == "mail me@post.example" and "Total findings:  1" in got.err and "  EMAIL: 1" in got.err
    assert run(["--text", "clean", "--fail-on-find"], spark) == 0
    capsys.readouterr()
    assert run(["--text", "mail me@post.example", "--format", "json"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["summary"]["findings_by_type"] == {"EMAIL": 1} and report["files"][0]["findings"][0]["line"] == 1
    assert run(["--input", "/no/such/file"], spark) == 2
    assert run(["--bad"], spark) == 2 and run(["--help"], spark) == 0


def test_directory_runs(spark, tree, tmp_path, capsys):
    assert run(["--input", str(tree)], spark) == 2
    out = tmp_path / "out"
    assert run(["--input", str(tree), "--output", str(out), "--fail-on-find"], spark) == 3
    assert (out / "a.txt").read_text() == f"mail {EMAIL}" and (out / "sub/b.txt").read_text() == "plain words" and not (out / "bin.dat").exists()
    assert "Processed 2 files, 1 findings, 3 skipped" in capsys.readouterr().err
    assert run(["--input", str(tree), "--in-place", "--report-json"], spark) == 0
    assert (tree / "a.txt").read_text() == f"mail {EMAIL}"
    report = json.loads(capsys.readouterr().err)
    status = {os.path.basename(f["path"]): f["status"] for f in report["files"]}
    roots = [f["path"] if f["path"].startswith("/") else str(tree / f["path"]) for f in report["files"]]
    assert roots == sorted(roots, key=lambda p: p.split("/"))
    assert status["a.txt"] == "processed" and status["bad.txt"] == "error" and status[".hidden"] == "skipped"
    assert run(["--input", str(tree / "bin.dat")], spark) == 0 and run(["--input", str(tree / "bin.dat"), "--binary", "fail"], spark) == 1


def test_stream(spark, tmp_path):
    from textveil.streaming.scan_stream import counts_stream, mask_stream

    spark.createDataFrame([(1, "a@bc.de and 10.0.0.1"), (2, "none")], "id long, text string").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "s"))
    q = mask_stream(stream).writeStream.format("memory").queryName("masked").start()
    q2 = counts_stream(stream, ["id"]).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q2.processAllAvailable()
    q.stop()
    q2.stop()
    assert {r.masked for r in spark.table("masked").collect()} == {f"{EMAIL} and {MARKER.format('IP')}", "none"}
    assert {(r.detector, r.n) for r in spark.table("counted").collect()} == {("EMAIL", 1), ("IP", 1)}
