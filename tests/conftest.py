import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from predio.session import local_session  # noqa: E402
from predio.schema import LISTING_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def listing(spark):
    """Build listings from partial records; missing fields take values that pass every rule."""
    base = {
        "sku": "a", "tipo_inmueble": "Casa", "tipo_oferta": "Venta", "sub_category": "x",
        "colonia": "Valle", "ciudad": "c", "estado": "e", "price": 2_000_000.0, "m2_terreno": 200.0,
        "m2_const": 150.0, "habitaciones": 3.0, "banos": 2.0, "autos": 1.0, "total_habitaciones": 5.0,
        "antiguedad": 4.0, "link": "l", "link_img": "i", "agent": "g", "divisa": "MXN",
        "fecha_pub": "2022-03-12", "descripcion": '"text":hola "text":mundo', "amenidades": ["alberca"],
        "lat": 20.6, "lng": -103.4,
    }

    def build(*records):
        rows = [{**base, "sku": f"s{i}", **r} for i, r in enumerate(records)]
        return spark.createDataFrame([[r[f] for f in LISTING_SCHEMA.fieldNames()] for r in rows], LISTING_SCHEMA)

    return build


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "out")
