"""Tables that change together: a stop between any two steps leaves the old or the new state; later changes win or are refused."""

import pytest

from sievework.sources.versions import ConflictError, State, VersionedTables

LAYOUT = "k STRING, v INT"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), LAYOUT)


def shown(store, table, state=None):
    return sorted(map(tuple, store.read(table, LAYOUT, state).collect()))


@pytest.fixture
def store(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "t"))
    assert store.state() == State() and shown(store, "now") == []
    store.change(store.state(), {"now": rows(spark, ("a", 1))}, {"log": rows(spark, ("a", 1))})
    return store


def test_versions(spark, store):
    first = store.state()
    second = store.change(first, {"now": rows(spark, ("a", 2), ("b", 1))}, {"log": rows(spark, ("a", 2))})
    third = store.change(second, append={"log": rows(spark, ("b", 1))})
    assert third.version == 3 == store.state().version and store.state() == third
    assert shown(store, "now") == [("a", 2), ("b", 1)] and shown(store, "log") == [("a", 1), ("a", 2), ("b", 1)]
    assert shown(store, "now", first) == [("a", 1)] and shown(store, "log", store.state(2)) == [("a", 1), ("a", 2)]
    with pytest.raises(ValueError, match="no version 9"):
        store.state(9)
    # a table may be replaced by what is read from it
    fourth = store.change(third, {"now": store.read("now", LAYOUT, third).filter("v > 1")})
    assert shown(store, "now") == [("a", 2)]
    assert store.clean(keep=1) == 2 and shown(store, "now") == [("a", 2)] and len(shown(store, "log")) == 3
    assert store.state() == fourth


def test_a_change_from_an_old_version_is_refused(spark, store):
    base = store.state()
    store.change(base, {"now": rows(spark, ("mine", 1))})
    with pytest.raises(ConflictError):
        store.change(base, {"now": rows(spark, ("other", 1))})
    assert shown(store, "now") == [("mine", 1)] and store.state().version == 2


STEPS = ["write now", "after now", "write log", "after log", "commit", "publish", "published"]


@pytest.mark.parametrize("stop", STEPS)
def test_a_stop_between_any_two_steps(spark, store, monkeypatch, stop):
    class Stop(Exception):
        pass

    def guarded(method, before, after):
        real = getattr(VersionedTables, method)

        def run(self, *args):
            if stop == before(*args):
                raise Stop
            out = real(self, *args)
            if stop == after(*args):
                raise Stop
            return out
        monkeypatch.setattr(VersionedTables, method, run)

    guarded("_write", lambda table, _: f"write {table}", lambda table, _: f"after {table}")
    guarded("_commit", lambda *_: "commit", lambda *_: None)
    guarded("_publish", lambda *_: "publish", lambda *_: "published")
    old = (shown(store, "now"), shown(store, "log"))
    with pytest.raises(Stop):
        store.change(store.state(), {"now": rows(spark, ("a", 7))}, {"log": rows(spark, ("a", 7))})
    found = (shown(store, "now"), shown(store, "log"))
    new = ([("a", 7)], [("a", 1), ("a", 7)])
    assert found == (new if stop == "published" else old)
    monkeypatch.undo()
    # the next change goes on as if nothing had happened, and the leavings can be removed
    store.change(store.state(), {"now": rows(spark, ("b", 1))}, {"log": rows(spark, ("b", 1))})
    store.clean(keep=1)
    assert shown(store, "now") == [("b", 1)] and len(shown(store, "log")) == len(found[1]) + 1
    assert len(store._names("data")) == 1 + len(store.state().tables["log"])
