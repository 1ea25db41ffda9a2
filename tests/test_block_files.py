import json

import pytest

from millrace.sources import block_files as bf


def line(i, text="x"):
    return json.dumps({"report_id": "r", "page_number": i // 3, "block_index": i, "text": text}, ensure_ascii=False)


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_every_line_once_at_any_split(spark, tmp_path, size):
    texts = [line(i, "é漢" * (i % 13)) for i in range(60)] + ["", "  "]
    (tmp_path / "a.jsonl").write_text("\n".join(texts))
    (tmp_path / "b.jsonl").write_text("\r\n".join(texts[:9]) + "\n")
    reader = bf._Reader({"path": str(tmp_path), "splitBytes": str(size)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[4] for r in rows) == sorted([*range(60), *range(9)]) and not any(r[-1] for r in rows)
    data = (tmp_path / "a.jsonl").read_bytes()
    assert all(json.loads(data[r[1] :].split(b"\n")[0])["block_index"] == r[4] for r in rows if r[0].endswith("a.jsonl"))


def test_bad_files_and_lines_are_rows(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "good.jsonl").write_text(line(0) + "\n" + line(4) + "\n")
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "broken.jsonl").write_bytes(b'{"report_id": "r"\n\xff\xfe\n[1]\n{"page_number": "3"}\n{"block_index": true}\n{"page_number": 99999999999999999999}\n' + line(9).encode())
    (tmp_path / "other.txt").write_text("not asked for")
    rows = bf.read_blocks(spark, str(tmp_path)).collect()
    assert sorted(r.block_index for r in rows if r.error is None) == [0, 4, 9]
    errors = {r.file.rsplit("/", 1)[1]: (r.errors, r.first) for r in bf.file_errors(bf.read_blocks(spark, str(tmp_path), splitBytes=10)).collect()}
    assert errors == {"empty.jsonl": (1, "empty file"), "broken.jsonl": (6, "JSONDecodeError: not a line of JSON")}
    assert [tuple(r) for r in bf.report_counts(bf.read_blocks(spark, str(tmp_path))).collect()] == [("r", 3, 3)]


def test_a_folder_without_files(spark, tmp_path):
    assert bf.read_blocks(spark, str(tmp_path)).count() == 0
