"""Readers whose tables repeat ids between cases and profiles."""

from footmark.sources import tables


def saved(spark, tmp_path, name, rows, schema):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).write.parquet(path)
    return path


PLACES = [("A", "p"), ("A", "q"), ("B", "p")]


def test_item_histories(spark, tmp_path):
    items = saved(spark, tmp_path, "items", [(c, u, 1, f"https://{c}{u}") for c, u in PLACES], "case_id string, user_profile string, id long, url string")
    seen = saved(spark, tmp_path, "visits", [(c, u, 1, 5.0, c + u) for c, u in PLACES],
                 "case_id string, user_profile string, history_item long, visit_time double, title string")
    got = {(r.case_id, r.user_profile, r.url, r.title) for r in tables.read_visits(spark, {"Safari": (items, seen)}).collect()}
    assert got == {(c, u, f"https://{c}{u}", c + u) for c, u in PLACES}
    assert tables.read_visits(spark, {"Safari": (items, seen)}).count() == 3


def test_annotated_downloads(spark, tmp_path):
    notes = saved(spark, tmp_path, "notes", [(c, u, 1, 7, "file:///" + c + u) for c, u in PLACES],
                  "case_id string, user_profile string, place_id long, anno_attribute_id long, content string")
    places = saved(spark, tmp_path, "places", [(c, u, 1, f"https://{c}{u}") for c, u in PLACES], "case_id string, user_profile string, id long, url string")
    names = saved(spark, tmp_path, "names", [("A", "p", 7, "downloads/destinationFileURI"), ("A", "q", 7, "other"), ("B", "p", 7, "downloads/destinationFileURI")],
                  "case_id string, user_profile string, id long, name string")
    got = {(r.case_id, r.user_profile, r.target_path, r.tab_url) for r in tables.read_downloads(spark, {"Firefox": (notes, places, names)}).collect()}
    assert got == {("A", "p", "file:///Ap", "https://Ap"), ("B", "p", "file:///Bp", "https://Bp")}


def test_usage_and_traffic(spark, tmp_path):
    objects = saved(spark, tmp_path, "objects", [(c, u, 1, "/app/usage", 0.0, 5.0) for c, u in PLACES],
                    "case_id string, user_profile string, metadata_id long, stream string, start_raw double, end_raw double")
    metadata = saved(spark, tmp_path, "metadata", [(c, u, 1, "b." + c + u) for c, u in PLACES], "case_id string, user_profile string, metadata_id long, bundle_id string")
    assert {(r.case_id, r.user_profile, r.bundle_id, r.seconds) for r in tables.read_app_usage(spark, objects, metadata).collect()} == {
        (c, u, "b." + c + u, 5) for c, u in PLACES}
    traffic = saved(spark, tmp_path, "traffic", [(c, 1, 9) for c in "AB"], "case_id string, process_id long, wifi_in long")
    processes = saved(spark, tmp_path, "processes", [("A", 1, "pkg.a"), ("B", 1, "pkg.b"), ("B", 2, "pkg.c")], "case_id string, process_id long, package string")
    got = tables.read_app_traffic(spark, traffic, processes)
    assert sorted((r.case_id, r.package) for r in got.collect()) == [("A", "pkg.a"), ("B", "pkg.b")]
