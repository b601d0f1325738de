"""Two import and two export manifests with every situation the reports cover.

Fixed values: the manifest lines below and the report figures in
``test_manifest_reports.py`` belong together.
"""

import pathlib

BASE_SECOND = 1573808000
CUTOFF_END_MS = 1573808995000  # 2019-11-15T09:09:55.000
MARGIN_MINUTES = 2

IMPORT_1 = r'''
{""id"": ""1""}|1573809420000|dbone|collectionone|import|HDI|{""id"": ""1""}|test_update
{""id"": ""4""}|1573809421000|dbone|collectionone|import|HDI|{""id"": ""4""}|test_update
{""id"": ""5""}|1573809422000|dbone|collectionfive|import|HDI|{""id"": ""5""}|test_update
{""importonlyid"": ""5""}|1573809420000|dbone|collectionfive|import|HDI|{""importonlyid"": ""5""}|test_update
{""importonlyidtwo"": ""5""}|1573808725000|dbimportonly|collectionfive|import|HDI|{""importonlyidtwo"": ""5""}|test_update
{""earlierinimportid"": ""21""}|1573809419000|dbone|collectionfive|import|HDI|{""earlierinexportid"": ""21""}|test_update
{""earlierinimportid"": ""22""}|1573809419000|dbone|collectionfive|import|HDI|{""earlierinexportid"": ""22""}|test_update
{""earlierinimportid"": ""23""}|1573809419000|dbone|collectionfive|import|HDI|{""earlierinexportid"": ""23""}|test_update
{""earlierinexportid"": ""24""}|1573809429000|dbone|collectionfive|import|HDI|{""earlierinexportid"": ""24""}|test_update
{""earlierinexportid"": ""25""}|1573809429000|dbone|collectionfive|import|HDI|{""earlierinexportid"": ""25""}|test_update
{""earlierinimportoutsidemarginid"": ""30""}|1573809720000|dbone|collectionfive|import|HDI|{""earlierinimportoutsidemarginid"": ""30""}|test_update
{""earlierinimportoutsidemarginid"": ""31""}|1573809721000|dbone|collectionfive|import|HDI|{""earlierinimportoutsidemarginid"": ""31""}|test_update
{""earlierinimportinsidemarginid"": ""32""}|1573809029000|dbone|collectionfive|import|HDI|{""earlierinimportinsidemarginid"": ""32""}|test_update
{""earlierinimportinsidemarginid"": ""33""}|1573809030000|dbone|collectionfive|import|HDI|{""earlierinimportinsidemarginid"": ""33""}|test_update
{""earlierinimportbeforebackuptakenid"": ""34""}|1573808721000|dbone|collectionfive|import|HDI|{""earlierinimportbeforebackuptakenid"": ""34""}|test_update
35|1573808722000|dbone|collectionfive|import|HDI|{""$oid"": ""35""}|test_update
{""importonlyoutsidemarginid"": ""40""}|1573809655000|dbone|collectionfive|import|HDI|{""importonlyoutsidemarginid"": ""40""}|test_update
{""importonlyoutsidemarginid"": ""41""}|1573809656000|dbone|collectionfive|import|HDI|{""importonlyoutsidemarginid"": ""41""}|test_update
{""importonlyinsidemarginid"": ""42""}|1573809008000|dbone|collectionfive|import|HDI|{""importonlyinsidemarginid"": ""42""}|test_update
{""importonlyinsidemarginid"": ""43"", "secondid": "43-2"}|1573809007000|dbone|collectionfive|import|HDI|{""importonlyinsidemarginid"": ""43"", "secondid": "43-2"}|MONGO_INSERT
{""importonlybeforebackuptakenid"": ""44"", "secondid": "44-2", "thirdid": "44-3"}|1573808725000|dbone|collectionfive|import|HDI|{""importonlybeforebackuptakenid"": ""44"", "secondid": "44-2", "thirdid": "44-3"}|MONGO_DELETE
{""importonlybeforebackuptakenid"": ""45"", "secondid": "45-2", "thirdid": "45-3"}|1573808726000|dbone|collectionfive|import|HDI|{""importonlybeforebackuptakenid"": ""45"", "secondid": "45-2", "thirdid": "45-3"}|MONGO_DELETE
{""importonlybeforebackuptakenid"": ""46"", "secondid": "46-2", "thirdid": "46-3"}|1573808726000|dbone|collectionfive|import|HDI|{""importonlybeforebackuptakenid"": ""46"", "secondid": "46-2", "thirdid": "46-3"}|test_update
{""earlierinexportoutsidemarginid"": ""50""}|1573809740000|dbone|collectionfive|import|HDI|{""earlierinexportoutsidemarginid"": ""50""}|test_update
{""earlierinexportinsidemarginid"": ""51""}|1573809031000|dbone|collectionfive|import|HDI|{""earlierinexportinsidemarginid"": ""51""}|test_update
{""earlierinexportinsidemarginid"": ""52""}|1573809032000|dbone|collectionfive|import|HDI|{""earlierinexportinsidemarginid"": ""52""}|test_update
{""earlierinexportinsidemarginid"": ""53""}|1573809033000|dbone|collectionfive|import|HDI|{""earlierinexportinsidemarginid"": ""53""}|test_update
{""earlierinexportbeforebackuptakenid"": ""54""}|1573808724000|dbone|collectionfive|import|HDI|{""earlierinexportbeforebackuptakenid"": ""54""}|test_update
{""earlierinexportbeforebackuptakenid"": ""55""}|1573808725000|dbone|collectionmismatched|import|HDI|{""earlierinexportbeforebackuptakenid"": ""55""}|test_update
"{""earlierinexportbeforebackuptakenid"": ""56""}"|1573808726000|dbone|collectionmismatched|import|HDI|"{""earlierinexportbeforebackuptakenid"": ""56""}"|test_update
guid57|1573808725000|dbone|collectionfive|import|HDI|{""$oid"":""guid57""}|MONGO_UPDATE
guid58|1573808725000|dbone|collectionfive|import|HDI|{""$oid"":""guid58""}|test_update
guid59|1573808725000|dbone|collectionfive|import|HDI|{""$oid"":""guid59""}|test_update
'''

IMPORT_2 = r'''
{""id"": ""6""}|1573809425000|dbone|collectionone|import|HDI|{""id"": ""6""}|test_update
{""id"": ""7""}|1573809426000|dbseven|collectionone|import|HDI|{""id"": ""7""}|test_update
{""id"": ""8""}|1573809427000|dbthree|collectionone|import|HDI|{""id"": ""8""}|test_update
9|1573809428000|dbone|collectionone|import|HDI|{""$oid"": ""9""}|test_update
{""collectionimportonly"": ""10""}|1573809420000|dbone|collectionimportonly|import|HDI|{""collectionimportonly"": ""10""}|test_update
{""collectionimportonly"": ""16""}|1573809420000|dbone|collectionimportonly|import|HDI|{""collectionimportonly"": ""16""}|test_update
{""collectionimportonly"": ""17""}|1573809420000|dbone|collectionimportonlytwo|import|HDI|{""collectionimportonly"": ""17""}|test_update
{""collectionimportonlyoutsidemarginid"": ""31""}|1573809624000|dbone|collectionimportonly|import|HDI|{""collectionimportonlyoutsidemarginid"": ""31""}|test_update
{""collectionimportonlyinsidemarginid"": ""33""}|1573809010000|dbone|collectionimportonly|import|HDI|{""collectionimportonlyinsidemarginid"": ""33""}|test_update
{""collectionimportonlybeforebackuptakenid"": ""35""}|1573808726000|dbone|collectionimportonlytwo|import|HDI|{""collectionimportonlybeforebackuptakenid"": ""35""}|test_update
{""sameinbothid"": ""60""}|1573808722000|dbone|collectionmismatched|import|HDI|{""sameinbothid"": ""60""}|test_update
{""sameinbothid"": ""61""}|1573808721000|dbone|collectionfive|import|HDI|{""sameinbothid"": ""61""}|test_update
{""duplicatedcollectionname"": ""62""}|1573808721000|dbone|collectionduplicatedone|import|HDI|{""duplicatedcollectionname"": ""62""}|test_update
{""duplicatedcollectionname"": ""63""}|1573808721000|dbone|dbduplicatedone|import|HDI|{""duplicatedcollectionname"": ""63""}|test_update
{""duplicatedcollectionname"": ""64""}|1573808721000|dbduplicatedone|dbduplicatedone|import|HDI|{""duplicatedcollectionname"": ""64""}|test_update
{""duplicatedcollectionname"": ""65""}|1573808721000|dbduplicatedone|collectionduplicatedone|import|HDI|{""duplicatedcollectionname"": ""65""}|test_update
{""defaulttopicid"": ""1""}|1573808721000|core|claimant|import|HDI|{""defaulttopicid"": ""1""}|test_update
{""defaulttopicid"": ""2""}|1573808721000|dbone|claimant|import|HDI|{""defaulttopicid"": ""2""}|test_update
{""defaulttopicid"": ""3""}|1573808721000|accepted-data|address|import|HDI|{""defaulttopicid"": ""3""}|test_update
{""defaulttopicid"": ""4""}|1573808721000|accepted-data|bankDetails|import|HDI|{""defaulttopicid"": ""4""}|test_update
'''

EXPORT_1 = r'''
{""id"": ""1""}|1573809421000|dbone|collectionone|export|automatedtests|{""id"": ""1""}|test_insert
{""exportonlyid"": ""2""}|1573808725000|dbexportonly|collectionone|export|automatedtests|{""exportonlyid"": ""2""}|test_insert
{""exportonlyidtwo"": ""3""}|1573809420000|dbthree|collectionone|export|automatedtests|{""exportonlyidtwo"": ""3""}|test_insert
{""id"": ""4""}|1573809422000|dbone|collectionone|export|automatedtests|{""id"": ""4""}|test_insert
{""id"": ""5""}|1573809423000|dbone|collectionfive|export|automatedtests|{""id"": ""5""}|test_insert
{""earlierinimportid"": ""21""}|1573809429000|dbone|collectionfive|export|automatedtests|{""earlierinimportid"": ""21""}|test_insert
{""earlierinimportid"": ""22""}|1573809429000|dbone|collectionfive|export|automatedtests|{""earlierinimportid"": ""22""}|test_insert
{""earlierinimportid"": ""23""}|1573809429000|dbone|collectionfive|export|automatedtests|{""earlierinimportid"": ""23""}|test_insert
{""earlierinexportid"": ""24""}|1573809419000|dbone|collectionfive|export|automatedtests|{""earlierinimportid"": ""24""}|test_insert
{""earlierinexportid"": ""25""}|1573809419000|dbone|collectionfive|export|automatedtests|{""earlierinimportid"": ""25""}|test_insert
{""earlierinimportoutsidemarginid"": ""30""}|1573809730000|dbone|collectionfive|export|automatedtests|{""earlierinimportoutsidemarginid"": ""30""}|test_insert
{""earlierinimportoutsidemarginid"": ""31""}|1573809731000|dbone|collectionfive|export|automatedtests|{""earlierinimportoutsidemarginid"": ""31""}|test_insert
{""earlierinimportinsidemarginid"": ""32""}|1573809030000|dbone|collectionfive|export|automatedtests|{""earlierinimportinsidemarginid"": ""32""}|test_insert
{""earlierinimportinsidemarginid"": ""33""}|1573809031000|dbone|collectionfive|export|automatedtests|{""earlierinimportinsidemarginid"": ""33""}|test_insert
{""earlierinimportbeforebackuptakenid"": ""34""}|1573808723000|dbone|collectionfive|export|automatedtests|{""earlierinimportbeforebackuptakenid"": ""34""}|test_insert
{""$oid"": ""35""}|1573808724000|dbone|collectionfive|export|automatedtests|35|test_insert
{""exportonlyoutsidemarginid"": ""40""}|1573809650000|dbone|collectionfive|export|automatedtests|{""exportonlyoutsidemarginid"": ""40""}|test_insert
{""exportonlyoutsidemarginid"": ""41""}|1573809651000|dbone|collectionfive|export|automatedtests|{""exportonlyoutsidemarginid"": ""41""}|test_insert
{""exportonlyinsidemarginid"": ""42""}|1573809006000|dbone|collectionfive|export|automatedtests|{""exportonlyinsidemarginid"": ""42""}|test_insert
{""exportonlyinsidemarginid"": ""43""}|1573809005000|dbone|collectionfive|export|automatedtests|{""exportonlyinsidemarginid"": ""43""}|test_insert
{""exportonlybeforebackuptakenid"": ""44""}|1573808725000|dbone|collectionfive|export|automatedtests|{""exportonlybeforebackuptakenid"": ""44""}|test_insert
{""exportonlybeforebackuptakenid"": ""45""}|1573808726000|dbone|collectionfive|export|automatedtests|{""exportonlybeforebackuptakenid"": ""45""}|test_insert
{""earlierinexportoutsidemarginid"": ""50""}|1573809730000|dbone|collectionfive|export|automatedtests|{""earlierinexportoutsidemarginid"": ""50""}|test_insert
{""earlierinexportinsidemarginid"": ""51""}|1573809030000|dbone|collectionfive|export|automatedtests|{""earlierinexportinsidemarginid"": ""51""}|test_insert
{""earlierinexportinsidemarginid"": ""52""}|1573809031000|dbone|collectionfive|export|automatedtests|{""earlierinexportinsidemarginid"": ""52""}|test_insert
{""earlierinexportinsidemarginid"": ""53""}|1573809031000|dbone|collectionfive|export|automatedtests|{""earlierinexportinsidemarginid"": ""53""}|test_insert
{""earlierinexportbeforebackuptakenid"": ""54""}|1573808723000|dbone|collectionfive|export|automatedtests|{""earlierinexportbeforebackuptakenid"": ""54""}|test_insert
{""earlierinexportbeforebackuptakenid"": ""55""}|1573808724000|dbone|collectionmismatched|export|automatedtests|{""earlierinexportbeforebackuptakenid"": ""55""}|test_insert
"{""earlierinexportbeforebackuptakenid"": ""56""}"|1573808724000|dbone|collectionmismatched|export|automatedtests|"{""earlierinexportbeforebackuptakenid"": ""56""}"|test_insert
{""$oid"":""guid58""}|1573808725000|dbone|collectionfive|export|automatedtests|guid58|test_insert
{""$oid"":""guid59""}|1573808725000|dbone|collectionfive|export|automatedtests|guid59|test_insert
{""$oid"":""guid60""}|1573808725000|dbone|collectionfive|export|automatedtests|guid60|test_insert
'''

EXPORT_2 = r'''
{""id"": ""6""}|1573809425000|dbone|collectionone|export|automatedtests|{""id"": ""6""}|test_insert
{""id"": ""7""}|1573809426000|dbseven|collectionone|export|automatedtests|{""id"": ""7""}|test_insert
{""id"": ""8""}|1573809427000|dbthree|collectionone|export|automatedtests|{""id"": ""8""}|test_insert
{""$oid"": ""9""}|1573809428000|dbone|collectionone|export|automatedtests|9|test_insert
{""collectionexportonly"": ""12""}|1573809420000|dbone|collectionexportonly|export|automatedtests|{""collectionexportonly"": ""12""}|test_insert
{""collectionexportonly"": ""13""}|1573809420000|dbone|collectionexportonlytwo|export|automatedtests|{""collectionexportonly"": ""13""}|test_insert
{""collectionexportonlyoutsidemarginid"": ""30""}|1573809625000|dbone|collectionexportonly|export|automatedtests|{""collectionexportonlyoutsidemarginid"": ""30""}|test_insert
{""collectionexportonlyinsidemarginid"": ""32""}|1573809009000|dbone|collectionexportonly|export|automatedtests|{""collectionexportonlyinsidemarginid"": ""32""}|test_insert
{""collectionexportonlybeforebackuptakenid"": ""34""}|1573808725000|dbone|collectionexportonlytwo|export|automatedtests|{""collectionexportonlybeforebackuptakenid"": ""34""}|test_insert
{""sameinbothid"": ""60""}|1573808722000|dbone|collectionmismatched|export|automatedtests|{""sameinbothid"": ""60""}|test_insert
{""sameinbothid"": ""61""}|1573808721000|dbone|collectionfive|export|automatedtests|{""sameinbothid"": ""61""}|test_insert
{""duplicatedcollectionname"": ""64""}|1573808721000|dbduplicatedone|dbduplicatedone|export|automatedtests|{""duplicatedcollectionname"": ""64""}|test_insert
{""duplicatedcollectionname"": ""65""}|1573808721000|dbduplicatedone|collectionduplicatedone|export|automatedtests|{""duplicatedcollectionname"": ""65""}|test_insert
{""defaulttopicid"": ""3""}|1573808721000|accepted-data|address|export|automatedtests|{""defaulttopicid"": ""3""}|test_insert
'''


def write(folder: str) -> tuple[str, str]:
    """Write the four files below ``folder``; returns the import and export folders."""
    root = pathlib.Path(folder)
    for side, texts in (("import", (IMPORT_1, IMPORT_2)), ("export", (EXPORT_1, EXPORT_2))):
        (root / side).mkdir(parents=True)
        for n, text in enumerate(texts, 1):
            (root / side / f"{side}-data-{n}.csv").write_text(text.strip())
    return str(root / "import"), str(root / "export")
