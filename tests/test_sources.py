import wave

import numpy as np
import pytest

from fathom.engine import Engine
from fathom.sources import loaders, media
from fathom.streaming.append import append_stream


def chirp(path, low, high, seconds=1.5, rate=8000, channels=1):
    t = np.arange(int(rate * seconds)) / rate
    x = np.sin(2 * np.pi * (low + (high - low) * t / (2 * seconds)) * t) * 15000
    with wave.open(str(path), "wb") as w:
        w.setparams((channels, 2, rate, 0, "NONE", ""))
        w.writeframes(np.repeat(x.astype("<i2"), channels).tobytes())


def test_mfcc_descriptors(tmp_path):
    chirp(tmp_path / "long.wav", 300, 900, 3)
    chirp(tmp_path / "short.wav", 300, 300, 0.03)
    chirp(tmp_path / "wide.wav", 300, 900, 3, 16000, 2)
    long, short = (media.mfcc_descriptors((tmp_path / f"{n}.wav").read_bytes()) for n in ("long", "short"))
    assert long.shape[0] > 2 and short.shape == (1, 40) and np.isfinite(long).all()
    wide = (tmp_path / "wide.wav").read_bytes()
    assert len(media.wave_samples(wide)) == len(media.wave_samples((tmp_path / "long.wav").read_bytes()))
    assert len(media.mfcc_descriptors(wide, 16000)) > len(media.mfcc_descriptors(wide))
    with pytest.raises(ValueError):
        media.mfcc_descriptors(b"RIFF, but no more")


@pytest.fixture
def birds(tmp_path):
    folder = tmp_path / "birds"
    (folder / "deep").mkdir(parents=True)
    for name, low, high in (("owl", 150, 250), ("dove", 500, 700), ("wren", 2800, 3600), ("deep/asked", 150, 250)):
        chirp(folder / f"{name}.wav", low, high)
    (folder / "broken.wav").write_bytes(b"?")
    (folder / "odd[1].wav").write_bytes((folder / "dove.wav").read_bytes())
    return str(folder)


def test_searching_by_sound(spark, birds, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), resolver=media.default_resolver(spark, birds, k=8))
    e.sql("CREATE TABLE calls (ring INT, song VECTOR)")
    e.sql("CREATE INDEX ON calls (song) USING knn")
    e.sql('INSERT INTO calls VALUES (5, "wren.wav"), (6, "owl.wav"), (7, "dove.wav")')
    found = e.sql('SELECT ring FROM calls WHERE KNN(song, "deep/asked.wav", 3)').rows()
    assert (found[0]["key"], found[0]["ring"]) == ("owl.wav", 6)
    for name in ("lost.wav", "broken.wav", "owl.flac"):
        with pytest.raises(ValueError):
            e.resolver.resolve(name)
    assert e.resolver.resolve("odd[1].wav") == e.resolver.resolve("dove.wav")


def test_a_kept_codebook_is_not_learned_again(spark, birds, tmp_path, monkeypatch):
    kept = str(tmp_path / "book")
    first = media.FolderResolver(spark, birds, (".wav",), 3, kept).resolve("owl.wav")
    monkeypatch.setattr(media.Codebook, "fit", lambda *_: pytest.fail("learned again"))
    again = media.FolderResolver(spark, birds, (".wav",), 3, kept)
    assert again.resolve("owl.wav") == pytest.approx(first)
    rows = media.descriptors(media.media_files(spark, birds, "owl.wav"))
    assert again.codebook.histograms(rows).first()["vec"] == pytest.approx(first)


def test_other_extractors_can_be_given(spark, birds):
    lengths = media.FolderResolver(spark, birds, (".wav",), 2, extractor=lambda name: lambda content: np.array([[len(content), 1]], np.float32))
    assert len(lengths.resolve("wren.wav")) == 2


def test_codebooks_need_descriptors(spark, tmp_path):
    with pytest.raises(ValueError):
        media.Codebook(3).fit(spark.createDataFrame([], "key string, descriptor array<float>"))
    for use in (lambda c: c.quantize(np.ones((2, 3))), lambda c: c.save(spark, str(tmp_path / "c"))):
        with pytest.raises(RuntimeError):
            use(media.Codebook(3))
    assert media.Codebook.load(spark, str(tmp_path / "nothing")) is None


LYRICS = 'track_id,track_name,track_artist,lyrics\nq7,Harbour,Ada,"tide ""in""\n  and\tout"\nq8,Mast,Bo,creak\nq3,Lost,Cy,nobody\n'
FEATURES = "track_id,energy,danceability,tempo\nq8,0.25,0.5,90\nq7,0.125,,\nq8,0.75,1.0,\n,9,9,9\n"


@pytest.fixture
def songs(spark, tmp_path):
    (tmp_path / "l.csv").write_text(LYRICS)
    (tmp_path / "f.csv").write_text(FEATURES)
    (tmp_path / "art").mkdir()
    (tmp_path / "art/q8.jpg").write_bytes(b".")
    return loaders.songs(spark, str(tmp_path / "l.csv"), str(tmp_path / "f.csv"), str(tmp_path / "art"))


def test_songs_and_their_features(songs):
    got = {r["id"]: r for r in songs.rows.collect()}
    assert [(got[i]["track_id"], got[i]["image"]) for i in (1, 2)] == [("q7", ""), ("q8", "q8.jpg")] and len(got) == 2
    assert got[1]["lyrics"] == "tide 'in' and out"
    assert got[1]["feat"] == [0, 0.125] + [0] * 10 and got[2]["feat"][:2] == [1.0, 0.75]


@pytest.mark.parametrize("batches", [1, 3])
def test_import_report(spark, songs, tmp_path, batches):
    e = Engine(spark, str(tmp_path / "w"))
    report = loaders.import_dataset(e, songs, batches=batches)
    assert report.rows_inserted == 2 and 1 <= report.batches <= batches
    assert report.indexes == ["id:bplus", "lyrics:inverted", "feat:knn"]
    assert [r["id"] for r in e.sql('SELECT id FROM tracks WHERE MATCH(lyrics, "creak")').rows()] == [2]


def test_import_limit_and_refusals(spark, songs, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    for rows in ("SELECT 1 AS no, true AS flag", "SELECT 1 AS no, CAST(NULL AS STRING) AS flag"):
        with pytest.raises(TypeError):
            loaders.import_dataset(e, loaders.Dataset("refused", [("no", "INT"), ("flag", "TEXT")], [], spark.sql(rows)))
    with pytest.raises(ValueError):
        loaders.import_dataset(e, songs, batches=0)
    assert e.tables() == []
    assert loaders.import_dataset(e, songs, limit=1).rows_inserted == 1
    exact = loaders.Dataset("n", [("no", "INT"), ("x", "FLOAT")], [], spark.sql("SELECT 1 AS no, 0.12345678901234567D AS x"))
    loaders.import_dataset(e, exact)
    assert e.sql("SELECT x FROM n").rows()[0]["x"] == 0.123456789012


def test_vectors_from_a_table_of_features(spark, songs, tmp_path):
    resolver = loaders.FeatureResolver(spark, str(tmp_path / "f.csv"))
    assert resolver.resolve("covers/q8.jpg") == [1.0, 0.75] + [0] * 9 and resolver.resolve("q7") == [0, 0.125] + [0] * 9
    assert media.AnyResolver(resolver).resolve("q8.wav")[0] == 1.0
    with pytest.raises(ValueError):
        resolver.resolve("q3.jpg")


def test_tracks_with_their_sound_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("track_id,album_title,artist_name,track_title,track_genres\n1203,A,Ada,Gale,\"[{'genre_id': '5', 'genre_title': 'Shanty'}, {'genre_title': 'Folk'}]\"\n8,B,Bo,Calm,\n55,C,Cy,Mute,\n ,D,Di,Void,\n")
    sound = tmp_path / "s"
    for folder, name in (("001", "001203.ogg"), ("", "001203.mp3"), ("", "000008.ogg"), ("", "000008.wav")):
        (sound / folder).mkdir(parents=True, exist_ok=True)
        (sound / folder / name).write_bytes(b".")
    rows = loaders.tracks(spark, str(tmp_path / "t.csv"), str(sound)).rows.orderBy("id").collect()
    assert [(r["track_id"], r["genre"], r["audio"]) for r in rows] == [("1203", "Shanty", "001203.ogg"), ("8", "", "000008.wav")]


def test_streams_append_to_tables(spark, tmp_path):
    spark.range(40, 47).selectExpr("id AS no", "concat('buoy ', id) AS label").write.parquet(str(tmp_path / "in"))
    e = Engine(spark, str(tmp_path / "w"))
    e.sql("CREATE TABLE buoys (no INT, label TEXT)")
    stream = spark.readStream.schema("no long, label string").parquet(str(tmp_path / "in"))
    append_stream(e, "buoys", stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["no"] for r in e.sql("SELECT no FROM buoys").rows()) == list(range(40, 47))
