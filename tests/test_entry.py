import pytest

import __spark_entry__ as entry


def test_only_what_is_absent_is_left_out():
    assert entry.present("glyphmill.plans.catalogue")
    assert not entry.present("glyphmill.llm.no_such_module") and not entry.present("no_such_module_at_all")
    with pytest.raises(ModuleNotFoundError):
        entry.present("no_such_package.module")


def test_every_query_of_the_core_has_sql():
    from glyphmill.plans import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL) <= set(entry.queries())
