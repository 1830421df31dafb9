import json

import pytest

from inkgauge import __main__ as command


def test_scores_of_a_session(tmp_path, capsys):
    text = "The red valve opens slowly when the street is wet and the lamp is lit by the guard at noon."
    record = {"prompt": text, "output": text, "counterfactuals": [{"prompt": "Something else.", "output": "A tide came in."}, {"prompt": " ", "output": "x"}],
              "conversation": [{"role": "user", "content": text}, {"role": "assistant", "content": text}]}
    file = tmp_path / "session.json"
    file.write_text(json.dumps(record))
    command.main(["score", "--session", str(file)])
    got = json.loads(capsys.readouterr().out)
    assert got["actual"]["ratio"] > 0.6 > got["baseline"]["ratio"] and got["counterfactuals"] == 1 and 0 < got["composite"] <= 1 and got["guidance"] > 0
    command.main(["score", "--prompt", "", "--output", ""])
    assert json.loads(capsys.readouterr().out)["composite"] == 0.0
    with pytest.raises(SystemExit):
        command.main(["score", "--unknown"])
