import pytest

from seedloom.profile import (
    DEFAULT_PROFILE,
    Profile,
    options_of_file,
    parse_options,
    profile_from_file,
    profile_from_options,
    profiles_from_toml,
)


def test_defaults():
    p = DEFAULT_PROFILE
    assert (p.k, p.window, p.min_seeds, p.end_bonus, p.min_score) == (4, 32, 5, 10, 30)
    assert p.squash_interval == 16 and p.xdrop == 21 and p.filter_span == 64
    st = p.statistics()
    assert st["lambda"] == pytest.approx(0.6337318420410156, abs=1e-12)
    assert st["expected_score"] == pytest.approx(-1.75)
    assert st["identity"] == pytest.approx(0.88796, abs=1e-5)
    assert st["relative_entropy"] == pytest.approx(0.91244, abs=1e-5)
    assert p.flank_scores() == {"match": 2, "mismatch": -3, "gap": -2, "min_score": 12}


@pytest.mark.parametrize("w,want", [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (31, 8), (32, 16), (33, 16), (256, 128)])
def test_squash_interval(w, want):
    assert Profile(window=w).squash_interval == want


@pytest.mark.parametrize(
    "kw",
    [{"k": 2}, {"k": 10}, {"window": 257}, {"min_seeds": 0}, {"min_seeds": 1025}, {"match": 0}, {"match": 32},
     {"mismatch": 0}, {"mismatch": 32}, {"gap_open": 32}, {"gap_extend": 0}, {"max_gap_len": 0},
     {"max_gap_len": 257}, {"end_bonus": 128}, {"min_score": -1}],
)
def test_limits(kw):
    with pytest.raises(ValueError):
        DEFAULT_PROFILE.replace(**kw)


def test_filter_switches():
    assert DEFAULT_PROFILE.replace(span_threshold=0).filter_span == 0
    assert DEFAULT_PROFILE.replace(enable_filter=False).filter_span is None


def test_options(tmp_path):
    p = profile_from_options(["-k", "6", "-w64", "-c", "3", "-p", "4", "-q", "2", "-R", "-S", "0"])
    assert (p.k, p.window, p.min_seeds, p.use_raw_score, p.span_threshold) == (6, 64, 3, True, 0)
    assert (p.ins_open, p.del_open, p.ins_extend, p.del_extend) == (4, 4, 2, 2)
    f = tmp_path / "preset"
    f.write_text("-k 5\n-m\t50 -a 3\n")
    q = profile_from_file(str(f))
    assert (q.k, q.min_score, q.match) == (5, 50, 3)
    for bad in (["-y", "1"], ["-k"], ["-k", "x"]):
        with pytest.raises(ValueError):
            profile_from_options(bad)


def test_option_words():
    o = parse_options(["a.fa", "-RLk5", "-S", "-1", "-z", "p.toml", "-G20", "-M", "5", "-m40", "-", "-k", "6"])
    assert o.profile == {"use_raw_score": True, "k": 6, "span_threshold": -1, "min_score": 40}
    assert o.run == {"lenient": True, "profiles": "p.toml", "patch_gap": 20, "patch_margin": 5}
    assert o.words == ("a.fa", "-")
    for bad, why in ((["-kR"], "number"), (["-k", "-R"], "needs a value"), (["-Rj"], "unknown option -j"), (["-G"], "needs")):
        with pytest.raises(ValueError, match=why):
            parse_options(bad)


def test_option_files_in_option_files(tmp_path):
    """A file's options count at its place, paths are relative to the file that names them, cycles are errors."""
    (tmp_path / "sub").mkdir()
    (tmp_path / "top").write_text("-k 5 -x sub/mid\n-m 70\t# -k 9\n'with space.fa'")
    (tmp_path / "sub" / "mid").write_text("-m 50 -x deep -w 40")
    (tmp_path / "sub" / "deep").write_text("-k 7 -w 64 -L -z 'my profiles.toml'\n\n")
    o = options_of_file(str(tmp_path / "top"))
    assert o.profile == {"k": 7, "min_score": 70, "window": 40}
    assert o.run == {"lenient": True, "profiles": "my profiles.toml"} and o.words == ("with space.fa",)
    assert parse_options(["-x", str(tmp_path / "top"), "-k4"]).profile["k"] == 4
    assert parse_options(["-k4", "-x", str(tmp_path / "top")]).profile["k"] == 7
    (tmp_path / "twice").write_text("-x sub/deep -x sub/deep")  # twice, but in no circle
    assert options_of_file(str(tmp_path / "twice")).profile == {"k": 7, "window": 64}
    (tmp_path / "sub" / "deep").write_text("-x ../top")
    with pytest.raises(ValueError, match="name each other"):
        options_of_file(str(tmp_path / "top"))
    (tmp_path / "self").write_text("-xself")
    with pytest.raises(ValueError, match="name each other"):
        options_of_file(str(tmp_path / "self"))
    with pytest.raises(FileNotFoundError):
        parse_options(["-x", str(tmp_path / "none")])


def test_toml(tmp_path):
    f = tmp_path / "p.toml"
    f.write_text(
        """
[alu]
name = "^Alu"
kmer_size = 5
min_seed_cnt = 4
gap_max = 20
enable_filter = false
score_matrix = [["A","C","G","T"],[2,-3,-3,-3],[-3,2,-3,-3],[-3,-3,2,-3],[-3,-3,-3,2]]

[rest]
comment = "LINE"
kmer = 6
ins_open = 7

[ignored]
kmer_size = 7
"""
    )
    alu, rest, last = profiles_from_toml(str(f))
    assert (alu.name, alu.name_pattern, alu.k, alu.min_seeds, alu.max_gap_len) == ("alu", "^Alu", 5, 4, 20)
    assert alu.filter_span is None
    assert alu.score("A", "A") == 2 and alu.score("A", "R") == 2 and alu.score("C", "R") == -3
    assert (rest.comment_pattern, rest.k, rest.ins_open, rest.del_open) == ("LINE", 6, 7, 5)
    assert last == DEFAULT_PROFILE
    f.write_text("[x]\nname='a'\nkm = 3\n")
    with pytest.raises(ValueError):
        profiles_from_toml(str(f))
