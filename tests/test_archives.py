"""Archives: ranges of members, each read once; odd names and bytes; damage; tasks that run twice."""

from __future__ import annotations

import os
import warnings
import zipfile
from collections import Counter

import pytest

from adjudica.sources.archives import read_archives, write_archives


def test_members_are_read_once_in_ranges(spark, tmp_path):
    os.makedirs(tmp_path / "deep")
    wanted = Counter()
    for k, path in enumerate(["a.zip", "deep/b c.zip", "deep/empty.zip"]):
        with zipfile.ZipFile(tmp_path / path, "w") as archive, warnings.catch_warnings():
            warnings.simplefilter("ignore")
            archive.mkdir("corpus/train")
            for i in range(0 if k == 2 else 40):
                text = "" if i == 3 else f"text {k} {i} " * (i + 1)
                archive.writestr(f"corpus/{('train', 'test')[i % 4 == 0]}/f{i}.txt", text)
                if i % 4:
                    wanted[f"corpus/train/f{i}.txt", text] += 1
            if k == 0:
                archive.writestr("corpus/train/f1.txt", "same name, other text")
                archive.writestr("corpus/train/bytes.txt", b"caf\xe9 \xf0\x9f\x99\x82")
                archive.writestr("corpus/train/notes.ann", "no text")
                wanted.update([("corpus/train/f1.txt", "same name, other text"), ("corpus/train/bytes.txt", "caf� 🙂")])
    (tmp_path / "deep" / "other.txt").write_text("no archive")
    rows = read_archives(spark, str(tmp_path), r"/train/.*\.txt$", span=500).collect()
    assert Counter((r["name"], r["text"]) for r in rows) == wanted
    assert len({(r["archive"], r["low"]) for r in rows}) > 10  # many ranges of two archives
    whole = read_archives(spark, str(tmp_path), r"/train/.*\.txt$").collect()
    assert Counter((r["name"], r["text"]) for r in whole) == wanted and len({(r["archive"], r["low"]) for r in whole}) == 2


def test_no_archives_and_no_members(spark, tmp_path):
    assert read_archives(spark, str(tmp_path)).count() == 0
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as archive:
        archive.writestr("a.txt", "x")
    assert read_archives(spark, str(tmp_path), "never").count() == 0


def test_damage_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("a.txt", "a passage that will be damaged")
    raw = (tmp_path / "x.zip").read_bytes()
    (tmp_path / "x.zip").write_bytes(raw.replace(b"passage", b"passagf", 1))
    with pytest.raises(Exception, match="CRC"):
        read_archives(spark, str(tmp_path)).collect()


def test_round_trip(spark, tmp_path):
    rows = [(f"d/{i}.txt", None if i == 5 else "é\n" * i) for i in range(30)]
    folder = f"file://{tmp_path}/out"
    for _ in range(2):  # written twice, one archive a partition stays
        write_archives(spark.createDataFrame(rows, "name string, text string").repartition(3, "name"), folder)
    assert all(f.startswith("part-") for f in os.listdir(tmp_path / "out") if f.endswith(".zip")) and len(os.listdir(tmp_path / "out")) <= 3
    found = {r["name"]: r["text"] for r in read_archives(spark, folder, span=20).collect()}
    assert found == {name: text or "" for name, text in rows}
    write_archives(spark.createDataFrame([], "name string, text string"), f"file://{tmp_path}/none")
    assert not (tmp_path / "none").exists()


def test_ranges_are_read_without_the_directory(tmp_path, monkeypatch):
    """Before, every range parsed the whole directory again, so the read grew with ranges times members."""
    from adjudica.sources import archives

    path, methods = str(tmp_path / "x.zip"), [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]
    (tmp_path / "x.zip").write_bytes(b"bytes before the archive")
    texts = [f"text {k} é " * 50 * k for k in range(len(methods))]
    with zipfile.ZipFile(path, "a") as archive:
        for k, (text, method) in enumerate(zip(texts, methods, strict=True)):
            archive.writestr(f"f{k}.txt", text, method)
    with zipfile.ZipFile(path) as archive:
        listed = [{"name": e.filename, "offset": e.header_offset, "packed": e.compress_size, "size": e.file_size, "crc": e.CRC, "method": e.compress_type, "flags": e.flag_bits} for e in archive.infolist()]
    assert list(archives._texts(path, listed)) == texts  # rarer methods by the directory
    monkeypatch.setattr(archives.zipfile, "ZipFile", None)
    assert list(archives._texts(path, listed[1:3])) == texts[1:3]
    (tmp_path / "x.zip").write_bytes((tmp_path / "x.zip").read_bytes().replace(b"text 1", b"text x", 1))
    with pytest.raises(zipfile.BadZipFile, match="CRC"):
        list(archives._texts(path, listed[1:2]))
