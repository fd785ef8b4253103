"""The command line."""

from __future__ import annotations

import json

import pandas as pd

from fluxion.__main__ import main
from fluxion.operators.simulate import trajectory
from fluxion.operators.systems import SYSTEMS


def test_commands(spark, tmp_path, capsys):
    s = SYSTEMS["duffing"]
    t, _, u = trajectory(s, 0, 0, 0.001, t_end=8)
    pd.DataFrame({"time": t, "pos": u[:, 0], "vel": u[:, 1]}).to_csv(tmp_path / "d.csv", index=False)
    path = str(tmp_path / "d.csv")
    assert main(["inspect", path])["pos"]["nulls"] == 0
    assert main(["ingest", path, "--to", str(tmp_path / "out")])["meta"]["variables"] == ["pos", "vel"]
    assert main(["intuit", path])["config"]["method"] in ("strong", "weak")
    assert "lorenz" in main(["systems"])
    main(["generate", "strogatz_growth", str(tmp_path / "g"), "--noise", "0.01"])
    assert main(["evaluate", str(tmp_path / "g"), "--system", "strogatz_growth", "--rhs", json.dumps(SYSTEMS["strogatz_growth"].rhs)])["score"] > 5
    assert capsys.readouterr().out
