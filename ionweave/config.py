"""Settings of a run: from keyword arguments, a command line, or an INI file that the command line overrides."""

from __future__ import annotations

import argparse
import configparser
import dataclasses
from dataclasses import dataclass, field

ALGORITHMS = ("dbscan", "hc_single", "hc_complete", "hc_average")
SCALINGS = ("off", "root", "log", "rank")


@dataclass(frozen=True)
class Settings:
    input_filepath: str = ""
    output_filename: str = ""
    checkpoint: str | None = None
    file_type: str = "mgf"
    representative_mgf: bool = False
    batch_size: int = 5000
    min_peaks: int = 5
    mz_interval: int = 1
    min_mz_range: float = 250.0
    min_mz: float | None = 101.0
    max_mz: float | None = 1500.0
    remove_precursor_tol: float | None = 1.5
    min_intensity: float = 0.01
    max_peaks_used: int = 50
    scaling: str = "off"
    hd_dim: int = 2048
    hd_Q: int = 16  # noqa: N815
    hd_id_flip_factor: float = 2.0
    cluster_charges: tuple[int, ...] = ()
    precursor_tol: tuple[float, str] = (20.0, "ppm")
    rt_tol: float | None = None
    fragment_tol: float = 0.05
    cluster_alg: str = "hc_complete"
    eps: float = 0.6
    refine: bool = True
    mz_binning: str = "unit"
    seed: int = 0
    #: Threads of a local session that the command line starts, the larger of the two; a cluster's own settings hold there.
    cpu_core_preprocess: int = 8
    cpu_core_cluster: int = 8
    #: Accepted so that command lines stay as they are; clustering runs on the executors either way.
    use_gpu_cluster: bool = False
    #: One ordered file for each output instead of a folder of ordered parts; all rows then go through one task.
    single_files: bool = False
    #: Rows of a block up to which one task clusters it.
    max_group: int = 8000
    #: Rows of a tile of a larger block; tiles of few rows are put together (``tiles.PANEL``).
    tile: int = 2048
    #: Reproduce the live behaviour of the representative, the tolerance mask and the retention time key.
    compat: bool = False
    extra: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        if self.file_type != "mgf":
            raise ValueError(f"file type {self.file_type!r} is not supported")
        if self.cluster_alg not in ALGORITHMS:
            raise ValueError(f"cluster_alg is one of {', '.join(ALGORITHMS)}")
        if self.scaling not in SCALINGS:
            raise ValueError(f"scaling is one of {', '.join(SCALINGS)}")
        if self.precursor_tol[1] not in ("ppm", "Da"):
            raise ValueError("the unit of precursor_tol is ppm or Da")
        if self.mz_binning not in ("unit", "fragment_tol"):
            raise ValueError("mz_binning is unit or fragment_tol")
        if self.hd_dim <= 0 or self.hd_dim % 64:
            raise ValueError("hd_dim must be a multiple of 64")

    def signature(self) -> dict:
        """The settings that an encoded checkpoint depends on."""
        names = "min_peaks mz_interval min_mz_range min_mz max_mz remove_precursor_tol min_intensity max_peaks_used scaling hd_dim hd_Q hd_id_flip_factor fragment_tol mz_binning seed".split()
        return {n: getattr(self, n) for n in names}


def _flag(text: str) -> bool:
    if text.lower() in ("1", "true", "yes", "on"):
        return True
    if text.lower() in ("0", "false", "no", "off", ""):
        return False
    raise ValueError(f"{text!r} is not true or false")


def _value(name: str, words: list[str]):
    """A setting from its words, by the kind of its default."""
    if name == "precursor_tol":
        return float(words[0]), (words[1] if len(words) > 1 else "ppm")
    if name == "cluster_charges":
        return tuple(int(w) for w in words)
    default = {f.name: f.default for f in dataclasses.fields(Settings)}[name]
    text = " ".join(words)
    if isinstance(default, bool):
        return _flag(text)
    if name in ("rt_tol", "min_mz", "max_mz", "remove_precursor_tol"):
        return None if text.lower() in ("", "none") else float(text)
    if isinstance(default, (int, float)):
        return type(default)(text)
    return None if text.lower() == "none" else text


def from_ini(path: str) -> dict:
    """Settings of an INI file; its sections' names don't matter, nor does the lack of one."""
    parser = configparser.ConfigParser()
    parser.optionxform = str
    with open(path, encoding="utf-8") as f:
        text = f.read()
    parser.read_string(text if text.lstrip().startswith("[") else "[settings]\n" + text)
    known = {f.name for f in dataclasses.fields(Settings)} - {"extra"}
    found = {}
    for section in parser.sections():
        for name, raw in parser[section].items():
            if name not in known:
                raise ValueError(f"{path}: no setting {name!r}")
            found[name] = _value(name, raw.strip("[]").replace(",", " ").split())
    return found


def from_args(args: list[str] | None = None) -> Settings:
    """Settings of a command line: input folder, output stem, options; ``-c FILE`` reads an INI file first."""
    p = argparse.ArgumentParser(prog="ionweave", description="Cluster tandem mass spectra.", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("input_filepath", nargs="?")
    p.add_argument("output_filename", nargs="?")
    p.add_argument("-c", "--config")
    for f in dataclasses.fields(Settings):
        if f.name in ("input_filepath", "output_filename", "extra"):
            continue
        if isinstance(f.default, bool):
            p.add_argument(f"--{f.name}", action=argparse.BooleanOptionalAction, default=None)
        else:
            p.add_argument(f"--{f.name}", nargs="+", default=None, help=f"default {f.default}")
    got = vars(p.parse_args(args))
    found = from_ini(got.pop("config")) if got.get("config") else {}
    got.pop("config", None)
    for name, raw in got.items():
        if raw is not None:
            found[name] = raw if isinstance(raw, (bool, str)) else _value(name, raw)
    if not found.get("input_filepath") or not found.get("output_filename"):
        p.error("an input folder and an output stem are required")
    return Settings(**found)
