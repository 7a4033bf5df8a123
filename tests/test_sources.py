import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from dishlens import schemas
from dishlens.sources import archive as A, events as E, inspections as N, pages as G

REVIEWS = [
    {"review_id": "r1", "user_id": "u", "business_id": "biz1", "stars": 5, "useful": 1, "funny": 0, "cool": 2, "text": "good"},
    {"review_id": "r2", "business_id": "biz2", "Stars": 3.5, "TEXT": "fine"},
    {"review_id": "r3", "business_id": "biz1", "stars": 4.0, "text": None},
]
BUSINESSES = [
    {"business_id": "biz1", "name": "One", "city": "Reno", "state": "NV", "categories": "Food, Bars"},
    {"business_id": "biz2", "name": "Two", "city": "Reno", "state": "NV", "categories": None},
    {"business_id": "biz1", "name": "One again", "city": "Las Vegas", "state": "NV", "categories": "Food"},
]


@pytest.fixture(params=["w:gz", "w"])
def tar_path(request, tmp_path):
    path = tmp_path / "corpus.tar"
    with tarfile.open(path, request.param) as tar:
        for name, rows in (("data/business.json", BUSINESSES), ("data/review.json", REVIEWS), ("data/review2.json", [])):
            lines = [json.dumps(r) for r in rows]
            lines.insert(1, "{not json") if lines else None
            lines.append('{"review_id": 7, "business_id": []}') if lines else None
            body = "\n".join(lines).encode()
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return str(path)


def test_archive_members(spark, tar_path, tmp_path):
    A.unpack(spark, tar_path, "review", str(tmp_path / "reviews"))
    A.unpack(spark, tar_path, "business", str(tmp_path / "businesses"))
    reviews = A.reviews(spark.read.parquet(str(tmp_path / "reviews"))).orderBy("line_no").collect()
    assert [(r.review_id, r.stars, r.text, r.useful) for r in reviews] == [
        ("r1", 5.0, "good", 1), ("r2", 3.5, "fine", 0), ("r3", 4.0, "", 0),
    ]
    found = A.businesses(spark.read.parquet(str(tmp_path / "businesses"))).orderBy("business_id").collect()
    assert [(b.business_id, b.name, b.categories) for b in found] == [("biz1", "One again", "Food"), ("biz2", "Two", "")]
    of_one = A.reviews_of(A.reviews(spark.read.parquet(str(tmp_path / "reviews"))), "biz1")
    assert [r.review_id for r in of_one.orderBy("line_no").collect()] == ["r1", "r3"]


def test_absent_member_fails(spark, tar_path, tmp_path):
    with pytest.raises(Exception, match="no entry containing"):
        A.unpack(spark, tar_path, "photos", str(tmp_path / "x"))


HEADER = "dba,camis,boro,latitude,longitude,inspection_date,nta,zipcode\n"


def write_csv(tmp_path, body, header=HEADER):
    path = tmp_path / "in.csv"
    path.write_text(header + body)
    return str(path)


def test_inspection_rows_are_cleaned(spark, tmp_path):
    path = write_csv(tmp_path, (
        '"A, Inc" , 1 ,Queens,40.7,-73.9,01/02/2023,QN70,11101\n'
        "B,,Queens,40.7,-73.9,01/02/2023,QN70,11101\n"
        "C,3,0,40.7,-73.9,01/02/2023,QN70,11101\n"
        "D,4,Queens,0,-73.9,01/02/2023,QN70,11101\n"
        "E,5,Queens,x,-73.9,01/02/2023,QN70,11101\n"
    ))
    records = N.valid_records(N.read_csv(spark, path)).collect()
    assert [(r.camis, r.dba, r.latitude, r.grade) for r in records] == [("1", "A, Inc", 40.7, "")]


def test_ragged_row_and_missing_key_fail(spark, tmp_path):
    with pytest.raises(Exception):
        N.valid_records(N.read_csv(spark, write_csv(tmp_path, "A,1,Queens\n"))).select("camis").collect()
    with pytest.raises(ValueError, match="camis"):
        N.read_csv(spark, write_csv(tmp_path, "A\n", "dba\n"))


def test_quoted_values_hold_line_breaks(spark, tmp_path):
    path = write_csv(tmp_path, '"A\n""B""",1,Queens,40.7,-73.9,01/02/2023,QN70,11101\nC,2,Queens,40.7,-73.9,,,\n')
    before = spark.conf.get("spark.sql.csv.parser.columnPruning.enabled")
    assert sorted((r.camis, r.dba) for r in N.read_csv(spark, path).collect()) == [("1", 'A\n"B"'), ("2", "C")]
    assert spark.conf.get("spark.sql.csv.parser.columnPruning.enabled") == before


@pytest.mark.parametrize("multi_line", [True, False])
def test_both_ways_of_splitting_refuse_ragged_rows(spark, tmp_path, multi_line):
    path = write_csv(tmp_path, "A,1,Queens\n")
    with pytest.raises(Exception):
        N.read_csv(spark, path, multi_line).select("camis").collect()


def test_latest_inspection_wins(spark, tmp_path):
    rows = [("a", "01/02/2023"), ("b", "2023-05-01"), ("a", "2023-01-03T00:00:00.000"), ("c", "x"), ("b", "01/01/2000"),
            ("d", "2023-01-01T00:00:00Z"), ("d", "01/01/2023"), ("c", "y"), ("a", "12/31/2022")]
    path = write_csv(tmp_path, "".join(f"{i},{k},Q,1,1,{d},,\n" for i, (k, d) in enumerate(rows)))
    latest = N.latest_records(N.valid_records(N.read_csv(spark, path)))
    assert {r.camis: r.dba for r in latest.collect()} == {"a": "2", "b": "4", "c": "3", "d": "5"}


def test_area_and_high_water(spark):
    df = spark.createDataFrame(
        [("1", "QN70", "1", "2024-01-02"), ("2", "QN31", "11101", "2024-01-02"), ("3", "QN31", "11377", "2024-01-02"), ("4", "QN72", "1", "2023-12-31")],
        "camis string, nta string, zipcode string, record_date string",
    ).withColumn("inspection_date", F.lit(""))
    assert sorted(r.camis for r in N.area_records(df, "astoria-lic").collect()) == ["1", "2", "4"]
    assert sorted(r.camis for r in N.area_records(df, "astoria-lic", "2024-01-01").collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="unknown area"):
        N.area_condition("nowhere")


def test_restaurant_rows_have_nulls(spark, tmp_path):
    path = write_csv(tmp_path, "A,1,,40.7,0,01/02/2023,QN70,\n")
    row = N.restaurant_rows(N.valid_records(N.read_csv(spark, path))).first()
    assert (row.camis, row.boro, row.longitude, row.zipcode, row.nta, row.address) == ("1", None, None, None, "QN70", None)


def test_review_events_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r", "u", "b", 4.5, 1, 2, 3, "t")] * 3, "review_id string, user_id string, business_id string, stars double, useful int, funny int, cool int, text string")
    E.write_review_events(df, str(tmp_path / "e"), limit=2)
    back = E.read_events(spark, str(tmp_path / "e"), schemas.REVIEW_EVENT, "parquet")
    assert back.count() == 2 and dict(back.dtypes)["useful"] == "float" and back.first().stars == 4.5
    check = E.check_schema(back, schemas.REVIEW_EVENT + ", extra STRING").first()
    assert check.records == 2 and check.missing == ["extra"]


def test_inspection_bronze_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([("1", "A", 40.7)], "camis string, dba string, latitude double")
    for _ in range(2):
        E.write_inspection_bronze(df, str(tmp_path / "b"), "lic", "2024-01-01")
    back = E.inspection_events(spark, str(tmp_path / "b"), "parquet").collect()
    assert len(back) == 1 and back[0].event_id and back[0].boro == "" and back[0].longitude == 0.0


def test_menu_events_of_both_forms(spark, tmp_path):
    item = {"dish_name": "d", "price": None, "modifiers": None, "stated_ingredients": None}
    E.write_menu_events(spark.createDataFrame([("b1", [item])], f"business_id string, items array<{schemas.MENU_ENTRY}>"), str(tmp_path / "m"))
    spark.createDataFrame([("c2", [item])], f"camis string, items array<{schemas.MENU_ENTRY}>").write.parquet(str(tmp_path / "m" / "old"))
    (tmp_path / "m" / "broken.parquet").write_bytes(b"nonsense")
    silent = E.silent_files(spark, str(tmp_path / "m"), "business_id STRING").collect()
    heard = {r[0] for r in E.menu_events(spark, str(tmp_path / "m")).select("_metadata.file_path").collect()}
    assert "broken.parquet" in {r.path.rsplit("/", 1)[1] for r in silent} and len(heard) == 2
    assert not heard & {r.path for r in silent}
    events = {r.business_id: r for r in E.menu_events(spark, str(tmp_path / "m"), "parquet").collect()}
    assert set(events) == {"b1", "c2"}
    assert events["b1"]["items"][0].modifiers == [] and events["b1"]["items"][0].price is None


def test_discovery_events_and_dead_letters(spark, tmp_path):
    df = spark.createDataFrame([("1", None), ("2", ["u"])], "camis string, source_urls array<string>")
    E.write_discovery_events(df, str(tmp_path / "d"))
    assert sorted(r.source_urls for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [[], ["u"]]
    E.append_dead_letters(df.withColumn("reason", F.lit("bad")), str(tmp_path / "x"), "import")
    letters = spark.read.parquet(str(tmp_path / "x")).collect()
    assert {(r.job_kind, r.error) for r in letters} == {("import", "bad")} and '"camis":"1"' in "".join(r.job_args for r in letters)


def test_raw_pages_by_domain_and_day(spark, tmp_path):
    spark.createDataFrame([("a.com", "2024-01-01", "x")], "domain string, scrape_date string, html string").transform(
        lambda d: E.write_raw_pages(d, str(tmp_path / "p")) or d
    )
    assert (tmp_path / "p" / "domain=a.com" / "scrape_date=2024-01-01").is_dir()


def test_one_page_per_restaurant(spark, tmp_path):
    for name in ("2024/50-1-1.html", "2024/50-1-2.html", "2024/7.html", "2025/50-1-1.html"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(name)
    got = {r.restaurant_id: r.html for r in G.read_page_files(spark, str(tmp_path)).collect()}
    assert got == {"50-1": "2024/50-1-1.html", "7": "2024/7.html"}


def test_half_written_day_is_replaced_and_batches_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("1", "A", 40.7)], "camis string, dba string, latitude double")
    day = tmp_path / "b" / "area=lic" / "date=2024-01-01"
    day.mkdir(parents=True)
    (day / "left-over.txt").write_text("x")
    E.write_inspection_bronze(df, str(tmp_path / "b"), "lic", "2024-01-01")
    assert E.inspection_events(spark, str(tmp_path / "b")).count() == 1
    found = spark.createDataFrame([("d", None)], "name string, source_urls array<string>")
    for _ in range(2):
        E.write_discovery_events(found, str(tmp_path / "d"), batch=7)
    assert E.read_events(spark, str(tmp_path / "d"), "name STRING").count() == 1


def test_repeated_json_names_take_the_last_value(spark):
    from dishlens.functions.jsonsel import select_json

    df = spark.createDataFrame([('{"a": 1, "a": 2}',)], "t string")
    assert df.select(select_json("t", F.lit("json:a"))).first()[0] == "2"
