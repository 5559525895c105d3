import pytest

from labeldates import __main__ as command
from labeldates import api
from labeldates.sources import tables


def test_plain_calls(spark):
    assert api.extract_expiry_fields(spark, "EXP 2026.11.05") == {"year": "2026", "month": "11", "day": "05", "final_date": "2026-11-05", "_kind": "EXP", "_raw": "2026.11.05"}
    many = api.extract_many(spark, [None, "MAY 2023", "소비기한 02.18"], from_crop=True)
    assert [m["final_date"] for m in many] == ["NONE", "2023-05-NONE", "NONE-02-18"] and many[1]["_via"] == "gap_fill_month_year"
    said = api.explain(spark, "사용기한 2O26.O9.I1 별도 표기")
    assert said["chosen"]["m"] == 9 and said["has_reference_phrase"]
    api.create_answer_view(spark.createDataFrame([("EXP 2026.11.05",)], "text string"), "answers")
    assert spark.sql("select answer.d from answers").first()[0] == 5


def test_commands(spark, tmp_path, capsys):
    texts = tmp_path / "texts.csv"
    texts.write_text("image_id,text\n1,EXP 2026.11.05\n2,nothing\n", encoding="utf-8")
    out = str(tmp_path / "out")
    assert command.main(["read", str(texts), out]) == 0
    assert sorted(tuple(r) for r in tables.read_csv(spark, out, tables.SUBMISSION).collect()) == [("1", "2026", "11", "05", "2026-11-05"), ("2", "NONE", "NONE", "NONE", "NONE")]
    labels = tmp_path / "labels.csv"
    labels.write_text("image_id,year,month,day,final_date,status,batch,tag_dot\n1,2026,11,05,2026-11-05,완료,A,TRUE\n2,2026,11,5,2026-11-5,완료,D,\n", encoding="utf-8")
    assert command.main(["evaluate", out, str(labels)]) == 0
    assert command.main(["compare", out, out, str(labels)]) == 0
    assert "all: up 0, down 0, same 2" in capsys.readouterr().out
    assert command.main(["validate", str(tmp_path)]) == 1  # a day of one digit
    assert command.main(["power", "297"]) == 0


def test_bad_command():
    with pytest.raises(SystemExit):
        command.main(["nothing"])
