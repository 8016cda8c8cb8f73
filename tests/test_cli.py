import numpy as np
import pytest
from make import pbm, pgm
from t88 import decode_file

from rasterloom.plans.cli import main


@pytest.mark.parametrize("argv,code", [(["-t", "0.3", "x"], 10), (["-T", "256", "x"], 11), ([], 4), (["-2", "-4", "x"], 6), (["x", "y"], 1)])
def test_bad_options(argv, code):
    assert main(argv) == code


def test_files(spark, tmp_path, capfdbinary):
    bits = np.random.default_rng(1).integers(0, 2, (9, 20)).astype(np.uint8)
    (tmp_path / "a.pbm").write_bytes(pbm(bits))
    (tmp_path / "b.pgm").write_bytes(pgm(bits * 255))
    (tmp_path / "c.pgm").write_bytes(pgm(bits * 255)[:-9])
    assert main(["-d", "-v", "-o", f"{tmp_path}/out", f"{tmp_path}/a.pbm", f"{tmp_path}/b.pgm"], spark) == 0
    assert (decode_file((tmp_path / "out/a.pbm.jb2").read_bytes()) == bits).all()
    assert (decode_file((tmp_path / "out/b.pgm.jb2").read_bytes()) == 1 - bits).all()
    assert b"width 20, height 9, 1 bits a pixel" in capfdbinary.readouterr().err
    assert main([f"{tmp_path}/c.pgm"], spark) == 3
    assert main(["-p", f"{tmp_path}/a.pbm"], spark) == 0
    assert (decode_file(capfdbinary.readouterr().out) == bits).all()
