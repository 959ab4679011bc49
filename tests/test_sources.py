"""Files of every kind the engine reads and writes."""

from __future__ import annotations

import io
import os
import tracemalloc
import warnings
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from fluxlake import schemas
from fluxlake.operators.scaling import ScalerParam, load_scaler, save_scaler
from fluxlake.plans import ingest
from fluxlake.sources import archives, profile, records, tables, text_layouts
from fluxlake.streaming.resample import stream_resample

T0 = datetime(2020, 1, 1)


def parsed(spark, lines, layout):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n bigint, line string")
    rows = text_layouts.layout_rows(df, layout, ["n"]).orderBy("n").collect()
    return [(r.n, r.ts, r.electron_flux) for r in rows]


def test_layout_a_rolls_over_and_skips_bad_lines(spark):
    got = parsed(
        spark,
        ["2020 400 30 05 6.5 1.5e2 9", "2020 1 0 0 0", "2020 1 0 0.5 0 3", "x 1 0 0 0 3", "2020  001\t01 02 03 +4_0.5", "2020 1 0 0 0 1.5f", "2020 0 0 0 0 2"],
        "a",
    )
    assert got == [
        (0, datetime(2021, 2, 4, 6, 5, 6, 500_000), 150.0),
        (4, datetime(2020, 1, 1, 1, 2, 3), 40.5),
        (6, datetime(2019, 12, 31), 2.0),
    ]


def test_layout_b_takes_both_stamp_forms_but_not_an_iso_stamp_with_two_values(spark):
    got = parsed(
        spark,
        ["2020-01-02 03:04:05 7.5", "2020-01-02T03:04:05 8", "2020-01-02T03:04:05 8 9", "2020-01-02 03:04:05", "2020-13-02 00:00:00 1", "2020-01-02 03:04:05.25 6 x"],
        "b",
    )
    assert got == [
        (0, datetime(2020, 1, 2, 3, 4, 5), 7.5),
        (1, datetime(2020, 1, 2, 3, 4, 5), 8.0),
        (5, datetime(2020, 1, 2, 3, 4, 5, 250_000), 6.0),
    ]


@pytest.fixture()
def text_files(spark):
    a, b = "2020 1 0 0 0 3", "2020-01-01 00:05:00 4"
    files = {
        "a.txt": ["# head", a, "broken", "2020 1 0 0"], "b.txt": ["% head", b, "  // note", "! more"], "mixed.txt": [b, a, b],
        "bad.txt": ["", "  ", "# note", "one", "two", "three", "four", "five"], "empty.txt": ["# nothing"],
    }
    rows = [("z", name, i, line) for name, lines in files.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "archive string, member string, line_no bigint, line string")


def test_layout_is_chosen_per_file(text_files):
    got = sorted((r.member, r.line_no, r.layout) for r in text_layouts.parse_text(text_files).collect())
    assert got == [("a.txt", 1, "A"), ("b.txt", 1, "B"), ("mixed.txt", 1, "A")]


def test_first_lines_of_unreadable_files_are_reported(text_files):
    got = sorted((r.member, r.line_no, r.line) for r in text_layouts.rejected_lines(text_files).collect())
    assert got == [("bad.txt", 2, "# note"), ("bad.txt", 3, "one"), ("bad.txt", 4, "two"), ("bad.txt", 5, "three"), ("bad.txt", 6, "four")]


@pytest.fixture()
def archive_dir(tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("day.TXT", "# flux\n2020 1 0 0 0 -1e31\n2020 1 0 5 0 2.5\n2020 1 0 0 0 9\n")
        z.writestr("meta.xml", '<m v="1"><sat>one</sat><sat>two</sat><q><flag level="3"> ok </flag></q></m>')
        z.writestr("more.XML", "<m><sat>three</sat></m>")
        z.writestr("bad.xml", "<m><sat>")
        z.writestr("plot.png", b"\x89PNG")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("day.txt", "2020-01-01 00:00:00 7\n2020-01-01 00:10:00 8\n")
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    return str(tmp_path)


def test_archives_become_one_signal(spark, archive_dir):
    got = archives.scan_archives(spark, archive_dir).orderBy("ts").collect()
    # The first value of 00:00 is a fill value: it wins over later ones of the archive and of the next archive.
    assert [(r.ts.minute, r.electron_flux) for r in got] == [(0, None), (5, 2.5), (10, 8.0)]


def test_xml_is_flattened_and_later_values_win(spark, archive_dir):
    members = archives.expand_archives(archives.list_archives(spark, archive_dir))
    assert {r.kind for r in members.select("kind").distinct().collect()} == {"txt", "xml", archives.SKIPPED}
    got = archives.metadata_maps(archives.archive_metadata(members)).collect()
    assert [(r.archive, r.metadata) for r in got] == [("b.zip", {"m@v": "1", "m/sat": "three", "m/q/flag": "ok", "m/q/flag@level": "3"})]


def test_absent_archives_are_an_empty_table(spark, tmp_path):
    got = records.optional_source(spark, lambda: archives.scan_archives(spark, str(tmp_path)), schemas.TRUTH_SIGNAL)
    assert got.schema == schemas.TRUTH_SIGNAL and got.isEmpty()


def test_absent_folder_is_an_empty_table(spark, tmp_path):
    absent = records.optional_source(spark, lambda: archives.scan_archives(spark, str(tmp_path / "none")), schemas.TRUTH_SIGNAL)
    assert absent.count() == 0
    with pytest.raises(FileNotFoundError):
        records.list_files(spark, str(tmp_path / "none"), "*.parquet")


def test_a_damaged_archive_goes_whole_and_is_reported(spark, tmp_path):
    line = "2020 1 0 0 0 3\n"
    for name in ("good", "bad"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as packed:
            packed.writestr("a.txt", line)
            packed.writestr("b.txt", "x" * 40)
    raw = (tmp_path / "bad.zip").read_bytes()
    (tmp_path / "bad.zip").write_bytes(raw.replace(b"x" * 40, b"x" * 39 + b"y", 1))
    (tmp_path / "none.zip").write_bytes(b"no archive")
    members = archives.expand_archives(archives.list_archives(spark, str(tmp_path)))
    assert {r.archive for r in members.where("kind = 'txt'").collect()} == {"good.zip"}
    skipped = {r.archive: r.reason for r in archives.skipped_archives(members).collect()}
    assert set(skipped) == {"bad.zip", "none.zip"} and "CRC" in skipped["bad.zip"]


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_members_are_unpacked_as_streams(method):
    """Contents far larger than a chunk, in every way of packing, empty ones too; no chunk of a deflated member is large."""
    content = {"a.txt": b"".join(b"%d 1.5 \xc3\xa9\n" % i for i in range(60_000)), "none.txt": b"", "zeros.bin": b"\0" * 3_000_000, "cut.txt": b"x\r\ny"}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", method) as z:
        for name, data in content.items():
            z.writestr(name, data)
    rows = list(archives._directory("m.zip", packed.getvalue()))
    assert [r[1] for r in rows] == list(content)
    for _, member, _, _, way, crc, size, data, reason in rows:
        chunks = list(archives._unpacked(data, way))
        assert b"".join(chunks) == content[member] and reason is None and archives._damage(member, data, way, crc, size) is None
        if method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            assert max(map(len, chunks), default=0) <= archives.CHUNK_BYTES
        assert archives._damage(member, data, way, crc ^ 1, size).startswith("BadZipFile: Bad CRC")
        if member == "a.txt":
            assert archives._damage(member, data[:-2000], way, crc, size) is not None
            assert list(archives._lines(data, way)) == content[member].decode().splitlines()
        if member == "cut.txt":
            assert list(archives._lines(data, way)) == ["x", "y"]


def _tree_fields(path, element):
    """The same fields by walking a whole tree."""
    text = (element.text or "").strip()
    own = [(path, text)] if text else []
    return own + [(f"{path}@{n}", v) for n, v in element.attrib.items()] + [f for child in element for f in _tree_fields(f"{path}/{child.tag}", child)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_xml_fields_as_a_stream_equal_those_of_the_tree(size):
    document = b'<?xml version="1.0"?><r a="1" b="&lt;"> t<!-- c --> u <x:e xmlns:x="urn:n" x:k="v">1<i/>tail</x:e>more<e> </e><e>\xc3\xa9 &amp; 2</e></r>'
    cut = lambda data: (lambda: (data[i:i + size] for i in range(0, len(data), size)))
    root = ElementTree.fromstring(document)
    assert list(archives.xml_fields(cut(document))) == _tree_fields(root.tag, root)
    for bad in (document[:-3], b"", b"plain", document + b"<z/>"):
        assert list(archives.xml_fields(cut(bad))) == []


def test_a_large_xml_member_takes_little_memory():
    record = b"<p><v>12345</v></p>" * 1000

    def read():
        yield b"<all>"
        for _ in range(200):
            yield record
        yield b"</all>"

    tracemalloc.start()
    count = sum(1 for _ in archives.xml_fields(read))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 200_000 and peak < 2_000_000


def test_members_of_the_same_name_are_kept_apart_and_dealt_to_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for i in range(40):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                z.writestr("day.txt", f"2020 1 0 {i} 0 {i + 1}\n")
    listed = archives.list_archives(spark, str(tmp_path))
    members = archives.archive_members(listed)
    assert members.count() == 40
    lines = archives.expand_archives(listed, ("txt",)).collect()
    assert sorted((r.member_no, r.line) for r in lines) == [(i, f"2020 1 0 {i} 0 {i + 1}") for i in range(40)]


def test_skipped_files_are_listed(spark, tmp_path):
    spark.createDataFrame([(T0, 1.0)], "ts timestamp_ntz, e2_flux double").coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "in" / "broken.parquet").write_bytes(b"PAR1 is not enough")
    skipped = records.skipped_files(spark, str(tmp_path / "in")).collect()
    assert [os.path.basename(r.source_file) for r in skipped] == ["broken.parquet"]


def test_variables_are_resolved_per_file_and_bad_files_skipped(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    write([(at(0), -1e31), (at(1), 2.0)], "Epoch timestamp_ntz, E2W_COR_FLUX double", "a.parquet")
    write([(at(0), [5.0, 1.0], 9.0), (at(2), [6.0, 1.0], 9.0)], "time timestamp_ntz, e2_flux array<double>, Flux double", "b.parquet")
    flat = tmp_path / "flat"
    flat.mkdir()
    for name in ("a", "b"):
        part = next(p for p in os.listdir(tmp_path / f"{name}.parquet") if p.endswith(".parquet"))
        os.link(tmp_path / f"{name}.parquet" / part, flat / f"{name}.parquet")
    (flat / "c.parquet").write_bytes(b"not parquet")
    got = records.read_directory(spark, str(flat)).orderBy("ts").collect()
    assert [(r.ts.minute, r.electron_flux) for r in got] == [(0, None), (1, 2.0), (2, 6.0)]
    with pytest.raises(FileNotFoundError):
        records.read_directory(spark, str(flat), pattern="*.orc")
    with pytest.raises(ValueError):
        records.read_directory(spark, str(flat), records.scan_vector)


def test_vectors(spark):
    df = spark.createDataFrame([(T0, [1.0, 2.0, 3.0, 4.0]), (T0, [-1e31, 0.0, 1.0])], "Epoch timestamp_ntz, BGSE array<double>")
    assert [tuple(r)[1:] for r in records.scan_vector(df).collect()] == [(1.0, 2.0, 3.0), (None, 0.0, 1.0)]
    with pytest.raises(ValueError):
        records.scan_vector(df.withColumn("BGSE", F.lit(1.0)))
    speed = spark.createDataFrame(
        [(T0, [-400.0, 30.0, 0.0], 5.0), (T0, [-1e31, -1e31, -1e31], -1.0)], "Epoch timestamp_ntz, V_GSE array<double>, Np double"
    )
    got = records.scan_plasma(speed).collect()
    assert got[0].solar_wind_speed == pytest.approx(401.1234, abs=1e-4) and got[0].plasma_density == 5.0
    assert got[1].solar_wind_speed is None and got[1].plasma_density is None


def test_candidate_order_and_override():
    assert records.resolve_column(["flux", "E2"], schemas.FLUX_NAMES, "flux") == "E2"
    assert records.resolve_column([], schemas.FLUX_NAMES, "flux", "mine") == "mine"
    with pytest.raises(ValueError):
        records.resolve_column(["other"], schemas.FLUX_NAMES, "flux")


def test_csv_keeps_types_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(T0 + timedelta(microseconds=7), 1.25, None), (T0, 1e-300, 2.0)], "ts timestamp_ntz, a double, b double")
    tables.write_csv(df, str(tmp_path / "t"))
    back = tables.read_csv(spark, str(tmp_path / "t"), df.schema)
    assert back.schema == df.schema and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_dataset_scan_reads_only_its_folder(spark, tmp_path):
    rows = [(T0, i, float(i), h, s) for i, (h, s) in enumerate((h, s) for h in "AB" for s in ("train", "val"))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, row_idx bigint, f double, horizon string, split string")
    tables.write_datasets(df, ["f"], str(tmp_path))
    got = tables.read_datasets(spark, str(tmp_path), "A", "val")
    assert [r.row_idx for r in got.collect()] == [1]
    assert "PartitionFilters: [isnotnull(horizon" in got._jdf.queryExecution().executedPlan().toString()
    assert tables.read_feature_order(spark, str(tmp_path)) == ["f"]


def test_scaler_parameters_survive(spark, tmp_path):
    params = [ScalerParam("Bx", 0.1 + 0.2, 3.0), ScalerParam("By", -1.0, 1.0)]
    save_scaler(spark, params, str(tmp_path / "s"))
    assert sorted(load_scaler(spark, str(tmp_path / "s")), key=lambda p: p.name) == params


def test_profile_and_coverage(spark):
    df = spark.createDataFrame([(2, T0, None), (1, T0, 5.0)], "id bigint, ts timestamp_ntz, v double")
    got = {r.column_name: r for r in profile.profile_source(df, ["id"]).collect()}
    assert (got["v"].n_rows, got["v"].n_nulls, got["v"].max_value, got["v"].sample) == (2, 1, "5.0", "5.0, NULL")
    assert got["id"].sample == "1, 2"
    assert profile.time_coverage(df).first().n_rows == 2


def test_ingest_end_to_end(spark, tmp_path, archive_dir):
    at = lambda m: T0 + timedelta(minutes=m)
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    save([(at(m), float(m + 1)) for m in range(0, 30, 2)], "Epoch timestamp_ntz, E2 double", "flux")
    save([(at(m), [1.0, 2.0, 3.0]) for m in range(5, 40, 5)] + [(at(10**7), [0.0] * 3)], "Epoch timestamp_ntz, BGSE array<double>", "field")
    save([(at(m), 400.0, 5.0) for m in range(5, 20, 5)], "Epoch timestamp_ntz, Vp double, Np double", "plasma")
    got = ingest.ingest(spark, *[str(tmp_path / n) for n in ("flux", "field", "plasma")], archive_dir, datetime(2025, 1, 1))
    grid = got["training"].orderBy("ts").collect()
    assert [r.ts.minute for r in grid] == [5, 10, 15, 20, 25]
    assert grid[0].goes_electron_flux == 8.0 and grid[3].solar_wind_speed is None and grid[4].Bz == 3.0
    assert got["validation"].count() == 3


def test_streamed_bins_match_the_batch(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=30 * i), float(i)) for i in range(100)] + [(T0 + timedelta(days=1), 0.0)]
    spark.createDataFrame(rows, "ts timestamp_ntz, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, v double").parquet(str(tmp_path / "in"))
    bins = stream_resample(stream, ["v"], timedelta(minutes=5), timedelta(minutes=1))
    query = bins.writeStream.format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = [(r.ts, r.v) for r in spark.table("bins").orderBy("ts").collect()]
    assert got == [(T0 + timedelta(minutes=5 * k), 10.0 * k + 4.5) for k in range(10)]
