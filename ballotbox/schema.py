"""Canonical tables and lookup dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POLYGON = "array<struct<x:double,y:double>>"
DETECTIONS = f"image_id bigint, engine string, engine_rank int, det_ix int, x1 double, y1 double, x2 double, y2 double, score double, symbology string, payload string, polygon {POLYGON}, extras map<string,string>"

#: Symbologies in class-id order.
SYMBOLOGIES = ["qr", "micro_qr", "aztec", "data_matrix", "pdf417", "code_128", "code_39", "code_93", "ean_13", "ean_8", "upc_a", "upc_e", "gs1_databar", "other_1d", "codabar", "itf", "maxicode"]
MATRIX = {"qr", "micro_qr", "aztec", "data_matrix", "maxicode"}
#: The 9-class model's symbologies by class id; its class 7 pools EAN and UPC.
LEGACY = ["qr", "code_128", "data_matrix", "code_39", "code_93", "pdf417", "gs1_databar", "other_1d", "micro_qr"]
NATIVE = SYMBOLOGIES[:14]
OTHER = "other_1d"
#: The engine whose model runs here, composed of this package's operators.
OWN = "native"
#: Engines in canonical order, which is also the tie-break.
ENGINES = (OWN, "apple_vision", "zxing", "wechat")

#: A decoder's own format names by symbology. Formats under "drop" give no row.
ZXING_FORMATS = {
    "qr": ["QRCode"],
    "aztec": ["Aztec"],
    "data_matrix": ["DataMatrix"],
    "pdf417": ["PDF417"],
    "code_128": ["Code128"],
    "code_39": ["Code39"],
    "ean_13": ["EAN13"],
    "upc_a": ["UPCA"],
    "micro_qr": ["MicroQRCode"],
    "code_93": ["Code93"],
    "ean_8": ["EAN8"],
    "upc_e": ["UPCE"],
    "gs1_databar": ["DataBar", "DataBarOmni", "DataBarStk", "DataBarStkOmni", "DataBarLtd", "DataBarLimited", "DataBarExp", "DataBarExpanded", "DataBarExpStk", "DataBarExpandedStacked"],
    "codabar": ["Codabar"],
    "itf": ["ITF"],
    "maxicode": ["MaxiCode"],
    "drop": ["MicroPDF417", "RMQRCode", "DXFilmEdge"],
}
#: The same for the vision framework.
VISION_FORMATS = {
    "qr": ["VNBarcodeSymbologyQR"],
    "micro_qr": ["VNBarcodeSymbologyMicroQR"],
    "aztec": ["VNBarcodeSymbologyAztec"],
    "data_matrix": ["VNBarcodeSymbologyDataMatrix"],
    "pdf417": ["VNBarcodeSymbologyPDF417"],
    "code_128": ["VNBarcodeSymbologyCode128"],
    "code_39": ["VNBarcodeSymbologyCode39", "VNBarcodeSymbologyCode39Checksum", "VNBarcodeSymbologyCode39FullASCII", "VNBarcodeSymbologyCode39FullASCIIChecksum"],
    "code_93": ["VNBarcodeSymbologyCode93", "VNBarcodeSymbologyCode93i"],
    "ean_13": ["VNBarcodeSymbologyEAN13"],
    "ean_8": ["VNBarcodeSymbologyEAN8"],
    "upc_e": ["VNBarcodeSymbologyUPCE"],
    "gs1_databar": ["VNBarcodeSymbologyGS1DataBar", "VNBarcodeSymbologyGS1DataBarExpanded", "VNBarcodeSymbologyGS1DataBarLimited"],
    "codabar": ["VNBarcodeSymbologyCodabar"],
    "itf": ["VNBarcodeSymbologyI2of5", "VNBarcodeSymbologyI2of5Checksum", "VNBarcodeSymbologyITF14"],
    "other_1d": ["VNBarcodeSymbologyMSIPlessey"],
    "drop": ["VNBarcodeSymbologyMicroPDF417"],
}
FORMATS = {"zxing": ZXING_FORMATS, "apple_vision": VISION_FORMATS}


def dim_symbology(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, s in MATRIX) for i, s in enumerate(SYMBOLOGIES)], "class_id int, symbology string, is_matrix boolean")


def dim_model_class(spark: SparkSession) -> DataFrame:
    rows = [(n, i, s) for n, names in ((9, LEGACY), (14, NATIVE)) for i, s in enumerate(names)]
    return spark.createDataFrame(rows, "num_classes int, class_id int, symbology string")


def format_rows() -> list[tuple[str, str, str | None, str]]:
    return [(decoder, x, None if symbology == "drop" else symbology, "drop" if symbology == "drop" else "map") for decoder, formats in FORMATS.items() for symbology, names in formats.items() for x in names]


def dim_decoder_format(spark: SparkSession) -> DataFrame:
    """(decoder, raw_format, symbology, action): some 50 rows, broadcast in every join."""
    return spark.createDataFrame(format_rows(), "decoder string, raw_format string, symbology string, action string")


def requestable(decoder: str) -> dict[str, list[str]]:
    """symbology -> the decoder's own names to ask for (of the zxing variants the first stands for all); dropped and pooled ones can't be asked for."""
    formats = FORMATS[decoder]
    return {s: names[:1] if decoder == "zxing" else names for s, names in formats.items() if s not in ("drop", OTHER)}


def symbology_of(class_id: int) -> str:
    if not 0 <= class_id < len(SYMBOLOGIES):
        raise ValueError(f"no symbology has class id {class_id}")
    return SYMBOLOGIES[class_id]
