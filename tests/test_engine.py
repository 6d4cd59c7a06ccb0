"""The dialect end to end, over small tables of boats, recipes and lighthouses."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.engine import Engine
from fathom.functions.text import Counted, Words, terms
from fathom.operators import evaluate
from fathom.plans.parser import SqlError
from fathom.sources import layout, storage


@pytest.fixture
def harbour(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "harbour"))
    e.sql("CREATE TABLE boats (berth INT, hull TEXT, length FLOAT)")
    e.sql("CREATE INDEX ON boats (berth) USING bplus")
    e.sql('INSERT INTO boats VALUES (40, "Heron", 9.5), (12, "Gannet", 7), (77, "Tern", 12.25), (12, "Skua", 6.5), (31, "Petrel", 8)')
    return e


def column(result, name):
    return [row[name] for row in result.rows()]


@pytest.mark.parametrize("where, hulls", [
    ("", ["Gannet", "Skua", "Petrel", "Heron", "Tern"]),
    ("WHERE berth = 12", ["Gannet", "Skua"]),
    ("WHERE berth BETWEEN 31 AND 40", ["Petrel", "Heron"]),
    ("WHERE berth > 31 LIMIT 1", ["Heron"]),
    ("WHERE berth <= 12", ["Gannet", "Skua"]),
    ('WHERE hull = "Tern"', ["Tern"]),
    ("WHERE berth = 13", []),
    ("LIMIT 0", []),
])
def test_rows_come_by_key(harbour, where, hulls):
    assert column(harbour.sql(f"SELECT hull FROM boats {where}"), "hull") == hulls


def test_deleting_needs_a_condition(harbour):
    assert harbour.sql("DELETE FROM boats").affected == 0
    assert harbour.sql("DELETE FROM boats WHERE berth >= 40").affected == 2
    assert harbour.sql("DELETE FROM boats WHERE berth = 99").affected == 0
    assert column(harbour.sql("SELECT berth FROM boats"), "berth") == [12, 12, 31]


def test_plan_lines_name_access_and_cost(harbour):
    found = harbour.sql("SELECT hull FROM boats WHERE berth BETWEEN 20 AND 50 LIMIT 2")
    lines = found.explain()
    assert lines[0][1].startswith("Index Range Scan using bplus on boats  (actual time=") and "rows=2  reads=" in lines[0][1]
    assert lines[1:3] == [(1, "Index Cond: berth >= 20 AND berth <= 50"), (1, "Limit: 2")] and found.reads > 0 and found.writes > 0
    again = harbour.sql("SELECT hull FROM boats WHERE berth = 40")
    assert again.explain()[1] == (1, "Index Cond: berth = 40") and again.writes == 0
    assert harbour.sql('SELECT hull FROM boats WHERE hull = "Tern"').explain()[0][1].startswith("Seq Scan on boats")
    assert harbour.totals["statements"] == 6 - 3 + 3 and harbour.totals["reads"] >= found.reads and harbour.totals["writes"] >= 2
    harbour.reset_metrics()
    assert set(harbour.totals.values()) == {0}


@pytest.mark.parametrize("statement", [
    "CREATE TABLE boats (x INT)", "INSERT INTO boats VALUES (1, \"a\")", "INSERT INTO boats (berth, keel) VALUES (1, 2)", "SELECT keel FROM boats", "SELECT berth FROM ferries",
    "CREATE INDEX ON boats (berth) USING skiplist", "CREATE INDEX ON boats (keel) USING hash", "CREATE INDEX ON boats (hull) USING inverted WITH (vocabulary = 0)",
    "CREATE INDEX ON boats (hull) USING inverted WITH (vocabulary = 1.5)", 'SELECT hull FROM boats WHERE HYBRID(berth, "f", hull, "w", 1)', "SELECT hull FROM boats WHERE berth != 12",
    'SELECT hull FROM boats WHERE MATCH(berth, "tern")',
])
def test_wrong_statements_are_errors(harbour, statement):
    with pytest.raises(ValueError):
        harbour.sql(statement)


def test_dropping_what_is_not_there_does_nothing(harbour):
    harbour.sql("DROP TABLE ferries")
    harbour.sql("DROP TABLE boats")
    assert harbour.tables() == []


RECIPES = {10: "roast pumpkin soup with ginger", 20: "cold cucumber salad", 30: "pumpkin ginger cake", 40: "plain barley bread"}


def test_text_search_goes_on_after_reopening(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kitchen"))
    e.sql("CREATE TABLE recipes (no INT, method TEXT)")
    e.sql("CREATE INDEX ON recipes (method) USING inverted")
    e.sql("INSERT INTO recipes VALUES " + ", ".join(f'({k}, "{v}")' for k, v in RECIPES.items()))
    ask = 'SELECT no FROM recipes WHERE MATCH(method, "pumpkin ginger")'
    assert column(e.sql(ask), "no") == [30, 10]  # fewer other words in the cake
    e.sql('INSERT INTO recipes VALUES (50, "ginger pumpkin")')
    assert column(e.sql(ask), "no") == [50, 30, 10]
    assert column(Engine(spark, e.storage.folder).sql(ask + " LIMIT 1"), "no") == [50]
    e.sql("DELETE FROM recipes WHERE no = 50")
    assert column(e.sql(ask), "no") == [30, 10]


def test_capped_vocabulary_follows_the_counts(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "k"))
    e.sql("CREATE TABLE notes (no INT, body TEXT)")
    e.sql("CREATE INDEX ON notes (body) USING inverted WITH (vocabulary = 1)")
    e.sql('INSERT INTO notes VALUES (1, "oak oak oak"), (2, "elm elm"), (3, "oak elm")')
    assert column(e.sql('SELECT no FROM notes WHERE MATCH(body, "elm")'), "no") == []
    e.sql('INSERT INTO notes VALUES (4, "elm elm elm elm")')
    assert column(e.sql('SELECT no FROM notes WHERE MATCH(body, "elm")'), "no") == [2, 3, 4]  # one term: all scores are equal, so by chunk
    assert column(e.sql('SELECT no FROM notes WHERE MATCH(body, "oak")'), "no") == []


def test_only_new_parts_are_built(harbour):
    e, folder = harbour, f"{harbour.storage.folder}/boats"
    e.sql("SELECT hull FROM boats WHERE berth = 12").rows()
    first = e.storage._built  # counts what is built from here on
    built = []
    e.storage._built = lambda at, build, by=None: first(at, lambda: (built.append(at), build())[1], by)
    e.sql('INSERT INTO boats VALUES (13, "Dunlin", 5)')
    assert column(e.sql("SELECT hull FROM boats WHERE berth BETWEEN 12 AND 13"), "hull") == ["Gannet", "Skua", "Dunlin"]
    assert len(built) == 1 and folder.endswith("boats")


def test_parts_are_merged_and_old_folders_cleared(harbour, spark, monkeypatch):
    monkeypatch.setattr(storage, "MOST_PARTS", 4)
    for i in range(6):
        harbour.sql(f'INSERT INTO boats VALUES ({100 + i}, "B{i}", 1)')
    table = harbour.storage.get("boats")
    assert len(table.parts) < 4 and len(column(harbour.sql("SELECT berth FROM boats"), "berth")) == 11
    assert harbour.storage.vacuum("boats") > 0
    again = Engine(spark, harbour.storage.folder)
    assert column(again.sql("SELECT hull FROM boats WHERE berth >= 104"), "hull") == ["B4", "B5"]
    numbers = again.storage._numbers()
    assert len(numbers) <= storage.KEPT_CATALOGS and json.loads(again.storage._read(f"_catalog/{numbers[-1]:012d}.json"))[0]["name"] == "boats"


def test_points_in_boxes_and_nearest(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "map"))
    e.sql("CREATE TABLE lights (name TEXT, at VECTOR)")
    e.sql("CREATE INDEX ON lights (at) USING rtree")
    box = "SELECT name FROM lights WHERE WITHIN(at, [-2, 3], [4, 8])"
    assert column(e.sql(box), "name") == []
    e.sql('INSERT INTO lights VALUES ("east", [6, 5]), ("north", [1, 8]), ("rock", [-2, 3]), ("pier", [3.5, 4])')
    assert column(e.sql(box), "name") == ["rock", "north", "pier"]
    near = e.sql("SELECT name FROM lights WHERE KNN(at, [3, 5], 3)")
    assert column(near, "name") == ["pier", "east", "north"] and near.rows()[1]["distance"] == 3
    assert column(e.sql("SELECT name FROM lights WHERE at = [1, 8]"), "name") == ["north"]
    e.sql('INSERT INTO lights VALUES ("mole", [3, 5])')
    assert column(e.sql("SELECT name FROM lights WHERE KNN(at, [3, 5], 1)"), "name") == ["mole"]


class Swatches:
    """Vectors for colour files."""

    held = {"red.png": [3, 0, 0], "rose.png": [3, 1, 1], "lime.png": [0, 3, 1], "navy.png": [0, 0, 2], "asked.png": [5, 1, 0]}

    def resolve(self, name):
        return self.held[name]


def test_hybrid_search_fuses_both_rankings(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "paint"), resolver=Swatches())
    e.sql("CREATE TABLE paints (code INT, swatch VECTOR, label TEXT)")
    e.sql("CREATE INDEX ON paints (swatch) USING knn")
    ask = 'SELECT * FROM paints WHERE HYBRID(swatch, "asked.png", label, "warm matt", 2)'
    with pytest.raises(SqlError, match="paints.label"):
        e.sql(ask)
    e.sql("CREATE INDEX ON paints (label) USING inverted")
    e.sql('INSERT INTO paints VALUES (7, "red.png", "gloss outdoor"), (8, "rose.png", "warm matt indoor"), (9, "lime.png", "matt outdoor"), (6, "navy.png", "cool gloss")')
    found = e.sql(ask)
    assert found.columns == ["code", "swatch", "label", "fused_score", "visual_score", "text_score"]
    assert column(found, "swatch") == ["rose.png", "lime.png"]  # in both rankings, above red, which is in one
    assert [text.split(" on ")[0] for _, text in found.explain() if text.startswith("Branch")] == ["Branch: KNN Index Scan", "Branch: Text Search Scan"]
    near = e.sql("SELECT code FROM paints WHERE KNN(swatch, [0, 0, 1], 2)")
    assert column(near, "key") == ["navy.png", "lime.png"] and near.rows()[0]["score"] == 1


def test_pruned_search_is_used_and_can_be_left_out(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "v"))
    rows = [(i, [float(j == i % 60) + 0.01 * (j == 60) for j in range(61)]) for i in range(600)]
    for name, options in (("pruned", ""), ("exact", " WITH (exact = 1)")):
        e.sql(f"CREATE TABLE {name} (no INT, v VECTOR)")
        e.sql(f"CREATE INDEX ON {name} (v) USING knn{options}")
        e.load(name, spark.createDataFrame(rows, "no long, v array<double>"))
        found = e.sql(f"SELECT no FROM {name} WHERE KNN(v, {[float(j == 7) for j in range(61)]}, 2)")
        assert sorted(column(found, "no")) == [127, 187] or sorted(column(found, "no")) == [127, 7]
        folders = [s.getPath().getName() for s in e.storage._path(name)[0].listStatus(e.storage._path(name)[1])]
        assert any("v-lists" in f for f in folders) and any("v-centroids" in f for f in folders)


def by_line(df, text, keep, window):
    return df.select(*keep, F.split(text, "/").alias("chunks"))


def first_letters(token):
    return F.left(token, F.lit(3))


def second_only(rankings, k):
    return rankings[1].orderBy(F.desc("score"), "key").limit(k)


def test_analyzer_chunker_and_fusion_can_be_given(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "own"), resolver=Swatches(), analyzer=first_letters, chunker=by_line, fuse=second_only)
    e.sql("CREATE TABLE paints (code INT, swatch VECTOR, label TEXT)")
    e.sql("CREATE INDEX ON paints (swatch) USING knn")
    e.sql("CREATE INDEX ON paints (label) USING inverted")
    e.sql('INSERT INTO paints VALUES (7, "red.png", "glossy/outdoor"), (8, "lime.png", "matte/glossary")')
    assert column(e.sql('SELECT code FROM paints WHERE MATCH(label, "gloss")'), "code") == [7, 8]
    index = e.text_index("paints", "label")
    assert {r["chunk_id"] for r in index.chunks.collect()} == {"0#0", "0#1", "1#0", "1#1"} and index.posting_files() > 0
    assert index.document_norm("0#0") == pytest.approx(index.norms().filter("chunk_id = '0#0'").first()["norm"]) and index.document_norm("9") == 0
    assert column(e.sql('SELECT code FROM paints WHERE HYBRID(swatch, "lime.png", label, "outside", 1)'), "code") == [7]


def test_deleting_by_media_file(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "own"), resolver=Swatches())
    e.sql("CREATE TABLE paints (code INT, swatch VECTOR)")
    e.sql("CREATE INDEX ON paints (swatch) USING knn")
    e.sql('INSERT INTO paints VALUES (7, "red.png"), (8, "lime.png"), (9, "red.png")')
    assert column(e.sql("SELECT code FROM paints WHERE KNN(swatch, [1, 0, 0], 9)"), "code") == [9, 8]
    assert e.sql('DELETE FROM paints WHERE swatch = "red.png"').affected == 2
    assert column(e.sql("SELECT code FROM paints WHERE KNN(swatch, [1, 0, 0], 9)"), "key") == ["lime.png"]


def test_other_index_kinds_can_be_given(spark, tmp_path):
    layout.register("descending", layout.Kind(lambda df, column: df.orderBy(F.desc(column))), serves=("range",))
    e = Engine(spark, str(tmp_path / "own"))
    e.sql("CREATE TABLE boats (berth INT, hull TEXT)")
    e.sql("CREATE INDEX ON boats (berth) USING descending")
    e.sql('INSERT INTO boats VALUES (4, "Heron"), (2, "Gannet"), (7, "Tern")')
    assert column(e.sql("SELECT hull FROM boats WHERE berth >= 4"), "hull") == ["Heron", "Tern"]
    assert [r["berth"] for r in layout.layout(e.storage, "boats", "berth").collect()] == [7, 4, 2]
    with pytest.raises(SqlError):
        e.sql("SELECT hull FROM boats WHERE berth = 4")
    with pytest.raises(ValueError):
        layout.register("hash", layout.KINDS["hash"])


def test_other_stop_words_can_be_given(spark, tmp_path):
    own = Words("porter2", frozenset({"boat", "red"}))
    e = Engine(spark, str(tmp_path / "own"), analyzer=own)
    e.sql("CREATE TABLE boats (no INT, note TEXT)")
    e.sql("CREATE INDEX ON boats (note) USING inverted")
    e.sql('INSERT INTO boats VALUES (1, "the red boats sailing"), (2, "a red boat"), (3, "the oars")')
    ask = 'SELECT no FROM boats WHERE MATCH(note, "{}", 5)'
    assert column(e.sql(ask.format("boats red")), "no") == [] and column(e.sql(ask.format("the")), "no") == [1, 3]
    found = e.sql(ask.format("sailed"))
    assert column(found, "no") == [1] and "Scan parquet" in found.spark_plan()
    rows = spark.createDataFrame([(1, "the red boats sailing")], "i int, text string")
    assert {r["term"] for r in terms(rows, "text", ["i"], own).collect()} == {"the", "sail"} == set(Counted(own)("the red boats sailing"))


def test_searches_are_compared(spark):
    asked = spark.range(3).withColumnRenamed("id", "query_id")
    true = lambda q: q.selectExpr("query_id", "explode(array(query_id, query_id + 1)) AS key")
    rows = evaluate.compare(asked, {"all": true, "half": lambda q: true(q).filter("key = query_id")}, "all")
    assert [(r["engine"], r["queries"], r["recall"], r["overlap"]) for r in rows] == [("all", 3, 1.0, 1.0), ("half", 3, 0.5, 0.5)]
    assert all(r["seconds"] > 0 and r["per_second"] > 0 for r in rows)
