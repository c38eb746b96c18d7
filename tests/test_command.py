from rowanmill import __main__ as command

SHEET = "Business Name,City,Phone Number,Lead Priority,Week Number\r\nCorner Shop One,Bristol,0117 952 4240,High,12\r\nCorner One Ltd,Bristol,,Low,12\r\n,,,,\r\nOther Place,Leeds,,,12\r\n"


def test_import_export_dashboard(spark, tmp_path, capsys):
    sheet, tables = tmp_path / "s.csv", str(tmp_path / "tables")
    sheet.write_text(SHEET, encoding="utf-8-sig")
    assert command.import_sheet(spark, tables, str(sheet), None, True) == {"created": 2, "merged": 1, "skipped": 1}
    assert [t.number for t in command.tables(spark, tables)] == [0, 0]
    command.main(["--tables", tables, "import", str(sheet), "--backfill-duplicates"])
    assert "'created': 2" in capsys.readouterr().out
    assert command.import_sheet(spark, tables, str(sheet), None, False) == {"created": 0, "merged": 3, "skipped": 1}
    command.main(["--tables", tables, "export", str(tmp_path / "out.csv"), "--city", "brist"])
    lines = (tmp_path / "out.csv").read_text(encoding="utf-8-sig").splitlines()
    assert len(lines) == 2 and "Corner Shop One" in lines[1] and ",Low," in lines[1]
    command.main(["--tables", tables, "dashboard", "--week", "12"])
    assert "Haifa,Bristol + Dubai,1,13,No" in capsys.readouterr().out
