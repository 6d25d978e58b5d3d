from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from salesledger.session import session  # noqa: E402
from salesledger.sources.schema import EXPENSES, OPEN_DATES, ORDERS, PRODUCTS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(
        "salesledger-tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def setting(spark):
    """Set SQL settings for one test."""
    before = {}

    def change(key: str, value: str) -> None:
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def at(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text) if text else None


@pytest.fixture
def make(spark):
    """Small domain tables from dictionaries; left-out columns get plain values."""

    class Make:
        @staticmethod
        def _rows(rows, schema, plain):
            made = []
            for number, row in enumerate(rows, 1):
                full = {**plain, "id": number, **row}
                for field in schema.fields:
                    value = full.get(field.name)
                    if isinstance(value, int) and field.dataType.simpleString().startswith("decimal"):
                        value = Decimal(value)
                    if field.name == "created_at" and isinstance(value, str):
                        value = at(value)
                    full[field.name] = value
                made.append(tuple(full[f.name] for f in schema.fields))
            return spark.createDataFrame(made, schema)

        def orders(self, *rows):
            plain = {"customer_name": "Ani", "quantity": 1, "total_price": 0, "payment_method": "cash",
                     "shipping_fee": 0, "status": "process"}
            return self._rows(rows, ORDERS, plain)

        def expenses(self, *rows):
            return self._rows(rows, EXPENSES, {"name": "Flour", "amount": 1, "price": 0})

        def products(self, *rows):
            return self._rows(rows, PRODUCTS, {"name": "Box", "price": 0})

        def dates(self, *days):
            return self._rows([{"date": d} for d in days], OPEN_DATES, {})

        def feed(self, *rows):
            return spark.createDataFrame(rows, "seq long, id long, op string, patch map<string,string>")

    return Make()
