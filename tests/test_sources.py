"""Row slices against plain lists, and a vault of real files."""

from pyspark.sql import functions as F

from quern.sources import slices, vault


def test_slices_of_files(spark, tmp_path):
    path = str(tmp_path / "rows")
    for name, n in (("a", 50), ("b", 31)):
        spark.createDataFrame([(f"{name}{i}",) for i in range(n)], "v string").coalesce(1).write.mode("append").parquet(path)
    rows = slices.numbered_rows(spark, path, ["v"])
    files = {r["v"][0]: r["file"] for r in rows.where("row = 0").collect()}
    windows = [(1, files["a"], 0, 8), (2, files["a"], 5, 13), (3, files["b"], 24, 32), (4, files["b"], 3, 3), (5, "absent", 0, 8), (6, files["a"], 49, 50)]
    w = spark.createDataFrame(windows, "window int, file string, start long, stop long")
    found = slices.slices(rows, w, 8)
    got = {}
    for r in found.orderBy("window", "place").collect():
        got.setdefault(r["window"], []).append(r["v"])
    assert got == {1: [f"a{i}" for i in range(8)], 2: [f"a{i}" for i in range(5, 13)], 3: [f"b{i}" for i in range(24, 31)], 6: ["a49"]}
    assert {r["window"]: (r["wanted"], r["held"]) for r in slices.incomplete(found, w).collect()} == {3: (8, 7), 5: (8, 0)}


def test_vault(spark, tmp_path):
    notes = {
        "a/One.md": "---\ntitulo: First\nstatus: Superado\n---\n# Head\ntext [[Two|alias]] and [[Three#part]]",
        "a/Two.MD": "# A heading \nbody",
        "plain.md": "no heading",
        "Templates/t.md": "text",
        ".obsidian/x.md": "text",
        "p.md": "---\nprivado: sim\n---\ntext",
        "q.md": "---\nstatus: Private\n---\ntext",
        "n.md": "---\nindex: não\n---\ntext",
        "y.md": "---\nindex: sim\n---\ntext",
        "e.md": "---\ntitulo: x\n---\n \n",
        "s.md": "password = hunter2hunter2",
        "image.png": "no note",
    }
    root = tmp_path / "vault"
    for name, text in notes.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    listed = vault.note_files(spark, str(root))
    assert {r["path"] for r in listed.collect()} <= set(notes) - {"image.png"}
    rows = spark.createDataFrame(list(notes.items()), "path string, content string")
    out = {r["path"]: r for r in vault.scan(rows).collect()}
    assert {k: r["left_out"] for k, r in out.items()} == {"a/One.md": None, "a/Two.MD": None, "plain.md": None, "Templates/t.md": "folder", ".obsidian/x.md": "folder", "p.md": "private", "q.md": "private", "n.md": "not_indexed", "y.md": None, "e.md": "empty", "s.md": "secret", "image.png": "kind"}
    assert [out[k]["title"] for k in ("a/One.md", "a/Two.MD", "plain.md")] == ["First", "A heading", "plain"]
    assert (out["a/One.md"]["status"], out["a/One.md"]["links"]) == ("superado", ["Two", "Three"])
    assert vault.scan(rows.where(F.lit(False))).count() == 0
