"""Fixtures written as pictures and read back are the same frames."""

from waybill.sources import fixtures, pictures
from waybill.sources.observations import read_images


def test_round_trip(spark, tmp_path):
    frames = fixtures.frames(spark, "signature", 3, (16, 24))
    assert pictures.save_clip(frames, str(tmp_path / "clip")) == 3
    assert sorted(p.name for p in (tmp_path / "clip").iterdir()) == ["00000000.png", "00000001.png", "00000002.png"]
    got = {r.frame_pos: r for r in read_images(spark, str(tmp_path / "clip"), "lq").collect()}
    for r in frames.collect():
        assert (got[r.frame_pos].h, got[r.frame_pos].w, got[r.frame_pos].c) == (16, 24, 3)
        assert got[r.frame_pos].px == r.px
