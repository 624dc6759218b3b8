"""Tables so large that a diversion's id is another feature's as well, which also makes loops of ids."""

import duckdb
import pytest

from fluvia import queries as q
from test_queries import same


def closed(ids):
    """The ids with all that they flow to."""
    todo, found = list(ids), set()
    while todo:
        if (k := todo.pop()) and k not in found:
            found.add(k)
            todo += [k // 2] + ([k // 3] if k % 7 == 0 else [])
    return sorted(found)


@pytest.fixture(scope="module")
def parts(tmp_path_factory, sf_dir):
    """(folder, connection) of a part table in which id 1000007 and others come twice."""
    there = tmp_path_factory.mktemp("parts")
    con = duckdb.connect()
    keys = ", ".join(f"({k - 1}, {n})" for n, k in enumerate(closed([*range(1, 60), 1000007, 1000014, 1000021, 1000042])))
    con.execute(f"""copy (select k as p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from (values {keys}) t(k, n)
      join '{sf_dir}/part.parquet' p on p.p_partkey = n order by k) to '{there}/part.parquet' (format parquet)""")
    con.execute(f"create view part as select * from '{there}/part.parquet'")
    return str(there), con


@pytest.mark.parametrize("name", ["add_divergence", "index_ids_both", "index_ids_formatted", "index_ids_from", "subset_network"])
def test_rows_with_an_id_in_common(spark, parts, name):
    there, con = parts
    assert same(q.QUERIES[name](spark, there), con.sql(q.SQL[name]))
