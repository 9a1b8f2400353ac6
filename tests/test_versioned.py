"""Versioned tables and the incremental refresh on top of them."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from convolens.operators import features as FT
from convolens.operators.segments import Cuts
from convolens.sources.versioned import VersionedTable
from convolens.streaming.refresh import FeatureStates, latest_features

MESSAGES = "cleaned_phone string, src_ord int, creation_time timestamp, msg_from string, message string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v int")


def test_keyed_rows_are_replaced_and_deltas_compacted(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], compact_after=3)
    assert t.read() is None and t.compact().number == 0
    t.add(frame(spark, [("a", 1), ("b", 1)]))
    t.add(frame(spark, [("a", 2), (None, 5)]))
    assert rows_of(t.read()) == [("a", 2), ("b", 1), (None, 5)]
    t.add(frame(spark, [("b", None), (None, 6)]))  # the third delta: folded into a snapshot
    assert t.manifest().deltas == () and t.manifest().snapshot and rows_of(t.read()) == [("a", 2), ("b", None), (None, 6)]
    assert rows_of(t.read(1)) == [("a", 1), ("b", 1)]  # an earlier version
    t.replace(frame(spark, [("z", 0)]))
    assert rows_of(t.read()) == [("z", 0)]
    gone = t.vacuum(keep=1)
    assert len(gone) == 4 and rows_of(t.read()) == [("z", 0)]


def test_a_repeated_write_changes_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.add(frame(spark, [("a", 1)]), token="run-1")
    t.add(frame(spark, [("a", 1)]), token="run-1")
    assert t.has("run-1") and t.manifest().number == 1 and rows_of(t.read()) == [("a", 1)]


def test_a_killed_writer_is_never_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    t = VersionedTable(spark, path, ["k"])
    t.add(frame(spark, [("a", 1)]))

    def killed(*_):
        raise KeyboardInterrupt

    # after the data, before the manifest
    monkeypatch.setattr(t._files, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        t.add(frame(spark, [("a", 2)]))
    # half a manifest under its working name, half a data folder
    (tmp_path / "t" / "_manifests" / ".half").write_text('{"snapshot": ')
    (tmp_path / "t" / "data-half").mkdir()
    again = VersionedTable(spark, path, ["k"])
    assert rows_of(again.read()) == [("a", 1)]
    again.add(frame(spark, [("a", 3)]))
    assert rows_of(again.read()) == [("a", 3)] and "data-half" in again.vacuum(1)


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t"), ["k"]) for _ in range(2))
    before = two.manifest()
    one.add(frame(spark, [("a", 1)]))
    with pytest.raises(FileExistsError):
        two._commit(before, deltas=("data-x",))
    names = [n for n in os.listdir(tmp_path / "t" / "_manifests") if n.endswith(".json")]
    assert len(names) == 1 and json.loads((tmp_path / "t" / "_manifests" / names[0]).read_text())["deltas"] != ["data-x"]


def message(phone, day, minute, who, text, n=0):
    return (phone, n, datetime(2024, 1, 1) + timedelta(days=day, minutes=minute), who, text)


def batch_of_day(spark, day, phones=6):
    texts = [("bot", "Estás a un paso de la aprobación"), ("user", "Sí, quiero"), ("bot", "Hemos recibido tu solicitud"),
             ("bot", "Hola, aprovecha tu oferta"), ("bot", "Quieres hablar con un asesor"), ("user", "No gracias")]
    rows = [message(f"55{p:08}", day, 10 * i, *texts[(p + day + i) % len(texts)], n=day * 10 + i) for p in range(phones) for i in range(4)]
    return spark.createDataFrame(rows, MESSAGES)


def whole(messages, specs):
    return rows_of(FT.conversation_features(messages, specs, cuts=Cuts()))


@pytest.fixture
def specs():
    return [*FT.chain(FT.DEFAULT_CHAIN), FT.TransferContext(), FT.Digest()]


def test_a_batch_reads_its_own_days_only(spark, tmp_path, specs):
    states = FeatureStates(spark, str(tmp_path / "h"), str(tmp_path / "f"), specs, "2024-01-05 00:00:00")
    everything = None
    read = []
    for epoch in range(5):
        batch = batch_of_day(spark, epoch)
        states.update(batch, epoch)
        everything = batch if everything is None else everything.unionByName(batch)
        notes = states.features.manifest().notes
        read.append((notes["messages_read"], notes["states_read"]))
    assert read == [(24, 0)] + [(24, 6)] * 4  # rows read do not grow with history
    got = latest_features(spark, str(tmp_path / "f"))
    want = FT.conversation_features(everything, specs, cuts=Cuts())
    assert rows_of(got.select(want.columns)) == rows_of(want)
    plan = states.history([19723])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "19723" in plan.split("PartitionFilters")[1]


def test_late_rows_and_replays(spark, tmp_path, specs):
    states = FeatureStates(spark, str(tmp_path / "h"), str(tmp_path / "f"), specs, "2024-01-05 00:00:00", least=5)
    late_day = [message("5500000000", 0, 5, "bot", "Estás a un paso de la aprobación", 1), message("5500000009", 0, 1, "user", "Sí", 1)]
    same_day = [message("5500000001", 2, 1, "bot", "Quieres hablar con un asesor", 2)]
    untimed = [("5500000002", 3, None, "user", "sin fecha")]
    batches = [batch_of_day(spark, 1), batch_of_day(spark, 2, 3), spark.createDataFrame(late_day, MESSAGES),
               spark.createDataFrame(same_day + untimed, MESSAGES), batch_of_day(spark, 3, 2).unionByName(batch_of_day(spark, 0, 2))]
    everything = None
    for epoch, batch in enumerate(batches):
        states.update(batch, epoch)
        everything = batch if everything is None else everything.unionByName(batch)
        got = latest_features(spark, str(tmp_path / "f"))
        want = FT.conversation_features(everything, specs, cuts=Cuts())
        assert rows_of(got.select(want.columns)) == rows_of(want), epoch
    states.update(batches[-1], len(batches) - 1)  # a replay
    assert rows_of(latest_features(spark, str(tmp_path / "f")).select(want.columns)) == rows_of(want)


def test_an_epoch_that_died_half_way_is_repeated(spark, tmp_path, specs, monkeypatch):
    states = FeatureStates(spark, str(tmp_path / "h"), str(tmp_path / "f"), specs, "2024-01-05 00:00:00")
    states.update(batch_of_day(spark, 0), 0)

    def killed(*_, **__):
        raise RuntimeError("lost")

    both = batch_of_day(spark, 1).unionByName(batch_of_day(spark, 2))
    for table in ("days", "running", "features"):
        with monkeypatch.context() as patch:
            patch.setattr(getattr(states, table), "add", killed)
            with pytest.raises(RuntimeError):
                states.update(both, 1)
    states.update(both, 1)
    want = FT.conversation_features(batch_of_day(spark, 0).unionByName(both), specs, cuts=Cuts())
    assert rows_of(latest_features(spark, str(tmp_path / "f")).select(want.columns)) == rows_of(want)


def test_features_without_merges_are_refused(spark, tmp_path):
    class Odd(FT.Feature):
        name, alias = "OddFeature", "odd"

        def aggregates(self, m):
            return {f"{self.prefix}n": F.count(F.lit(1))}

    with pytest.raises(ValueError):
        FeatureStates(spark, str(tmp_path / "h"), str(tmp_path / "f"), [Odd()], "2024-01-05 00:00:00")
