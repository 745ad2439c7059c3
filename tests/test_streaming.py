from __future__ import annotations

from permaway.streaming import tables


def test_each_arriving_file_is_drawn_once(spark, tmp_path):
    folder, drawn = tmp_path / "in", []
    folder.mkdir()
    write = lambda fragments, number: drawn.extend((r.line, r.content.count("\n          1")) for r in fragments.collect())
    for name in ("a", "b"):
        (folder / f"{name}.csv").write_text("#h\n" + "".join(f"{name},{-33 - k},{151 + k},0\n" for k in range(4)))
        tables.draw_arriving(spark, str(folder), str(tmp_path / "state"), write).awaitTermination()
    assert [d[0] for d in drawn] == ["a", "b"]
