"""One session for all tests; dumps of our own for the shredder."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path[:0] = [x for x in [ROOT] if x not in sys.path]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


ARTISTS = """<artist><id>11</id><name>Ada &amp; Co</name><realname> Ada B </realname><profile>first
second</profile><data_quality>Fine</data_quality><namevariations><name>A.</name><name></name><name>  </name></namevariations><urls><url>http://a</url></urls><aliases><name id="21">Al</name></aliases><groups><name id="31">Gr</name></groups><members><name id="41">M1</name><name id="42">M2</name></members></artist>
<artist><id>12</id><name>Bo</name><data_quality>Poor</data_quality></artist>
"""
LABELS = """<label><id>5</id><name>Big</name><contactinfo>street</contactinfo><data_quality>Fine</data_quality><profile>p</profile><parentLabel id="4">Huge</parentLabel><urls><url>u1</url><url>u2</url></urls><sublabels>
<label id="6">Small</label>
<label id="7">Tiny</label>
</sublabels></label>
<label><id>9</id><name>Solo</name><data_quality>Poor</data_quality></label>
"""
MASTERS = """<master id="101"><main_release>7</main_release><title>T</title><year>1999</year><notes>n</notes><data_quality>Fine</data_quality><artists><artist><id>11</id><name>Ada</name><anv>A</anv><join>&amp;</join></artist><artist><id>12</id><name></name></artist></artists><genres><genre>Rock</genre></genres><styles><style>Punk</style></styles><videos><video src="s1" duration="60" embed="true"><title>v</title><description>d</description></video><video src="s2" duration="" embed=""><title>w</title></video></videos></master>
<master id="102"><title>U</title><data_quality>Poor</data_quality></master>
"""
RELEASES = """<release id="1001" status="Accepted"><title>R</title><country>DE</country><released>2001-00-00</released><notes>n</notes><data_quality>Fine</data_quality><master_id is_main_release="true">101</master_id><genres><genre>Rock</genre></genres><styles><style>Punk</style></styles><artists><artist><id>11</id><name>Ada</name><anv></anv><join>,</join></artist><artist><id>13</id><name></name></artist></artists><extraartists><artist><id>14</id><name>Eve</name><anv>E</anv><role>Mix</role><tracks>1 to 2</tracks></artist></extraartists><labels><label id="5" name="Big" catno="C1"/></labels><series><series id="8" name="Ser" catno="2"/></series><formats><format name="CD" qty="1" text="t"><descriptions><description>Album</description><description></description></descriptions></format></formats><identifiers><identifier type="Barcode" description="x" value="123"/></identifiers><videos><video src="s" duration="abc" embed="true"><title>v</title><description>d</description></video><video src="z"><title>w</title></video></videos><companies><company><id>77</id><name>Plant</name><catno>c</catno><entity_type>4</entity_type><entity_type_name>Pressed By</entity_type_name></company></companies><tracklist><track><position>A</position><title>One</title><duration>3:00</duration><artists><artist><id>11</id><name>Ada</name></artist></artists><extraartists><artist><id>14</id><name>Eve</name><role>Mix</role><tracks>lost</tracks></artist></extraartists><sub_tracks><track><position>A1</position><title>Sub</title><sub_tracks><track><title>deep</title></track></sub_tracks></track><track><position>A2</position><title>Sub2</title><artists><artist><id>12</id><name>Bo</name></artist></artists></track></sub_tracks></track><track><position>B</position><title>Two</title></track></tracklist></release>
<release id="1002" status="Draft"><title>S</title><data_quality>Poor</data_quality></release>
"""
DUMPS = {"artists": ARTISTS, "labels": LABELS, "masters": MASTERS, "releases": RELEASES}


@pytest.fixture
def dump(tmp_path):
    """Writes a dump file and returns its path; frame adds header and footer."""

    def write(entity, body=None, frame=True, gz=False, name=None):
        import gzip

        body = DUMPS[entity] if body is None else body
        text = f'<?xml version="1.0" encoding="UTF-8"?>\n<{entity}>\n{body}</{entity}>\n' if frame else body
        path = tmp_path / (name or f"dump_20260101_{entity}.xml{'.gz' if gz else ''}")
        data = text.encode()
        path.write_bytes(gzip.compress(data) if gz else data)
        return str(path)

    return write
