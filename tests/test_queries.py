"""Every registered query against its SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))

from oracle import SF_DIR, check

from lemmaflow.queries import QUERIES, SQL, entry

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no data folder")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    check(spark, QUERIES[name], SQL[name])


def test_file_as_bits(spark):
    """The one query without SQL: words of the file, little-endian, padded with zeros."""
    assert set(QUERIES) - set(SQL) == {"bit_file"}
    data = Path(f"{SF_DIR}/region.parquet").read_bytes()
    got = {r.word_idx: (r.n_bits, r.word % (1 << 64)) for r in QUERIES["bit_file"](spark, SF_DIR).collect()}
    assert got == {k: (8 * len(data), int.from_bytes(data[8 * k : 8 * k + 8], "little")) for k in range(-(-len(data) // 8))}


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
