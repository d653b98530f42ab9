"""Journals: what a killed or repeated write leaves, two writers, streams that follow the log."""

import pytest

from shoebox.sources import sinks as K
from shoebox.sources.journal_store import Journal
from shoebox.streaming import rollup as R

EFFECTS = "sequence bigint, effect_key string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def effects(spark, *numbers):
    return spark.createDataFrame([(n, f"k{n}") for n in numbers], EFFECTS)


def test_a_killed_write_leaves_the_journal_as_it_was(spark, tmp_path):
    path = str(tmp_path / "j")
    write = K.append_effects(path)
    write(effects(spark, 1, 2, 2), 0)
    journal = Journal(spark, path)
    folder = journal.stage(effects(spark, 3, 4))  # killed before its commit
    (tmp_path / "j" / "drafts").mkdir(exist_ok=True)
    (tmp_path / "j" / "drafts" / "half").write_text('{"batch": 1, "fol')  # killed within it
    assert rows(K.read_effects(spark, path)) == [(1, "k1"), (2, "k2")]
    write(effects(spark, 3), 1)
    write(effects(spark, 9), 1)  # another attempt of a batch that is there
    assert rows(K.read_effects(spark, path)) == [(1, "k1"), (2, "k2"), (3, "k3")]
    assert journal.sweep() == 2 and not (tmp_path / "j" / "data" / folder).exists()
    assert rows(journal.read()) == [(1, "k1"), (2, "k2"), (3, "k3")] and [c.batch for c in journal.commits()] == [0, 1]


def test_two_writers_never_share_a_number(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "j"))
    one, other = journal.stage(effects(spark, 1)), journal.stage(effects(spark, 2))
    assert journal.commit(0, one) and not journal.commit(0, other)
    assert rows(journal.read()) == [(1, "k1")]
    assert journal.append_new(effects(spark, 1, 5, 5), "sequence") == 1 and journal.append_new(effects(spark, 5), "sequence") == 2
    assert rows(journal.read()) == [(1, "k1"), (5, "k5")]


def test_a_faster_writer_is_seen(spark, tmp_path, monkeypatch):
    journal, commit, tries = Journal(spark, str(tmp_path / "j")), Journal.commit, []

    def slow(self, batch, folder):
        tries.append(batch)
        if len(tries) == 1:
            commit(self, batch, self.stage(effects(spark, 1)))
        return commit(self, batch, folder)

    monkeypatch.setattr(Journal, "commit", slow)
    assert journal.append_new(effects(spark, 1, 2), "sequence") == 1 and tries == [0, 1]
    assert rows(journal.read()) == [(1, "k1"), (2, "k2")]


def test_a_stream_follows_the_log(spark, tmp_path):
    path, at = str(tmp_path / "j"), str(tmp_path / "at")
    journal = Journal(spark, path)
    journal.append(effects(spark, 1, 2), 0)
    assert rows(R.deliveries(journal.stream(EFFECTS), at)) == [(1, "k1", 0), (2, "k2", 0)]
    journal.stage(effects(spark, 7))
    journal.append(effects(spark, 3), 1)
    assert rows(R.deliveries(journal.stream(EFFECTS), at)) == [(1, "k1", 0), (2, "k2", 0), (3, "k3", 1)]


def test_history_and_receipts(spark, tmp_path):
    path = str(tmp_path / "h")
    with pytest.raises(ValueError, match="committed"):
        K.read_stored(spark, path)
    assert Journal(spark, path).read(EFFECTS).collect() == []
    K.append_history(effects(spark, 1, 2), path)
    K.append_history(effects(spark, 2, 3), path)
    assert rows(K.read_stored(spark, path)) == [(1, "k1"), (2, "k2"), (3, "k3")]


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    path, check = str(tmp_path / "j"), tmp_path / "check"
    effects(spark, 1, 2, 2).write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(EFFECTS).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(K.append_effects(path)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    (check / "commits" / "0").unlink()  # the stream died after the journal's commit and before its own
    for crc in (check / "commits").glob(".0.crc"):
        crc.unlink()
    run()
    effects(spark, 3).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert rows(K.read_effects(spark, path)) == [(1, "k1"), (2, "k2"), (3, "k3")] and [c.batch for c in Journal(spark, path).commits()] == [0, 1]
