"""Search by trigrams gives the rows of a scan, whatever the term, and reads the folders of its trigrams only."""

from newsloom.operators import search

ROWS = [
    (1, "Nation and STATION", "a summary", "Press"), (2, "100% sure_thing", None, None), (3, "back\\slash", "under_score 100 percent", ""), (4, "바둑 대국 결과", "기원", "신문"),
    (5, "ÉCOLE élémentaire", "İstanbul Kelvin K", "x"), (6, "", "", ""), (7, None, None, None), (8, "ab", "cd", "ef"), (9, "na", "tion", "al"), (10, "word " * 5000 + "needle", "s", "p"), (11, "emoji 😀😀😀 end", "line\nbreak", "q"),
]
SCHEMA = "id long, title string, summary string, press string"
TERMS = ("TION", "nation", "0% s", "e_t", "k\\s", "바둑 대", "국 결과", "ÉCOLE", "élé", "i̇st", "kelvin k", "ab", "a", "abcdef", "needle", "rd word w", "😀😀", "😀😀😀 e", "line\nb", "zzz", "word " * 15 + "word")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_rows_of_a_scan(spark, tmp_path):
    rows, path = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "t")
    search.append_trigrams(rows, path, folders=16)
    table = search.read_trigrams(spark, path, rows)
    for term in TERMS:
        assert ids(search.matching(rows, term, table, folders=16)) == ids(search.matching(rows, term)), term
    assert ids(search.matching(rows, "nation", table, folders=16)) == [1]  # not 9: no trigram spans two fields
    assert search.candidates(table, "ab") is None


def test_what_comes_and_changes_is_appended(spark, tmp_path):
    path, old = str(tmp_path / "t"), spark.createDataFrame(ROWS, SCHEMA)
    search.append_trigrams(old, path)
    changed = [(1, "quite another", "thing", "Press"), (12, "Stations of late", "s", "p")]
    search.append_trigrams(spark.createDataFrame(changed, SCHEMA), path)
    search.append_trigrams(spark.createDataFrame(changed, SCHEMA), path)  # a batch that comes again
    now = spark.createDataFrame(changed + ROWS[1:], SCHEMA)
    table = search.read_trigrams(spark, path, now)
    for term, want in (("station", [12]), ("another", [1]), ("needle", [10])):
        assert ids(search.matching(now, term, table)) == want == ids(search.matching(now, term))


def test_empty_tables(spark, tmp_path):
    none, path = spark.createDataFrame([], SCHEMA), str(tmp_path / "t")
    search.append_trigrams(none, path)
    assert ids(search.matching(none, "station", search.read_trigrams(spark, path, none))) == []


def test_only_the_folders_of_the_term_are_read(spark, tmp_path):
    rows, path = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "t")
    search.append_trigrams(rows, path)
    found = search.candidates(search.read_trigrams(spark, path, rows), "station")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    assert "PushedFilters: [In(gram" in plan
    assert plan.count("Exchange") == 1
