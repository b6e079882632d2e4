"""CSV files of one path must agree in their header."""

import pytest

from apronflow.sources import readers


def write(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def test_files_of_one_header_are_read(spark, tmp_path):
    write(tmp_path, "a.csv", "Flight_ID, airline,terminal,extra", "F1,X,T1,1")
    path = write(tmp_path, "b.csv", "Flight_ID, airline,terminal,extra", "F2,Y,T2,2")
    df = readers.read_raw(spark, "flights", path)
    assert df.columns == ["flight_id", "airline", "terminal", "extra"]
    assert sorted(map(tuple, df.select("terminal", "flight_id").collect())) == [("T1", "F1"), ("T2", "F2")]
    assert df.count() == 2


@pytest.mark.parametrize("other", ["terminal,flight_id,airline", "flight_id,airline,gate", "flight_id,airline"])
def test_other_headers_are_refused(spark, tmp_path, other):
    write(tmp_path, "a.csv", "flight_id,airline,terminal", "F1,X,T1")
    path = write(tmp_path, "b.csv", other, ",".join("F2 Y T2".split()[: other.count(",") + 1]))
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_raw(spark, "flights", path).collect()
