"""The command line, on Parquet and SQLite."""

import sqlite3
import struct

from vellum.__main__ import main


def test_cli(spark, tmp_path, capsys):
    page = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    db = sqlite3.connect(tmp_path / "c.db")
    db.execute("create table page_tokens (book_id integer, part_index integer, page_id integer, token_ids blob)")
    db.execute("create table token_definitions (id integer, surface text, lemma_id integer, root_id integer)")
    db.executemany("insert into page_tokens values (?, 1, ?, ?)", [(b, k, page(range(k * 50, k * 50 + 50))) for b in (1, 2) for k in range(4)])
    db.executemany("insert into token_definitions values (?, ?, ?, null)", [(i, f"w{i}", i + 1) for i in range(200)])
    db.execute("create table pages (book_id integer, part_index integer, page_id integer, part_label text, page_number text, primary key (book_id, part_index, page_id)) without rowid")
    db.executemany("insert into pages values (?, 1, ?, 'first', ?)", [(1, 0, "xii"), (1, 1, None), (2, 0, "no")])
    db.commit()
    corpus = str(tmp_path / "c.db")
    main(["stats", corpus])
    assert "token_count: 400" in capsys.readouterr().out
    main(["info", corpus, "1", "--show-pages"])
    out = capsys.readouterr().out
    assert "unique_lemmas: 200" in out and "1:0 xii 50" in out and "1:1 first 50" in out and "1:2 - 50" in out and "no" not in out.split()
    main(["compare", corpus, "1", "2", str(tmp_path / "o.json"), "--window-size", "100", "--stride", "50", "--csv", str(tmp_path / "o.csv"), "--show-edges", "1"])
    out = capsys.readouterr().out
    assert "Edges found: 1" in out and "Edge 0:" in out and len((tmp_path / "o.csv").read_text().splitlines()) == 2
    main(["compare", corpus, "1", "2", str(tmp_path / "o.html"), "--format", "viewer", "--quiet", "--no-use-weights", "--no-filters"])
    assert "w10" in (tmp_path / "o.html").read_text()
