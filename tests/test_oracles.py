"""Every query with reference SQL gives the same rows in DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from prioscope import fixtures
from prioscope.functions.durable import durable
from prioscope.operators import model

SQL = entry.oracle_sql()


@pytest.fixture(scope="module", autouse=True)
def shared(spark, sf_dir):
    """Tickets are cleaned, and a model is trained, once for all queries."""
    tickets = durable(fixtures.tickets(spark, sf_dir))
    trained = {}

    def train(labelled, config):
        key = (config, labelled.count())
        if key not in trained:
            trained[key] = train_once(labelled, config)
        return trained[key]

    train_once = model.train
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fixtures, "tickets", lambda spark, sf_dir: tickets)
        patch.setattr(model, "train", train)
        yield


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_reference_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, duck, name):
    assert differences(entry.queries()[name](spark, sf_dir), duck, SQL[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
