"""An invented bank of titles with what each should be read as, and queries that read one for every order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators import extract
from bazaarlens.plans.fixtures import table

N = None
#: title, category, condition, lot_size, completeness, has_defect, is_accessory, price_is_from, capacity_gb, spec_generation, form_factor, model_key
BANK = [
    ("Lot of 12 assorted toy trains", "Toys", N, 12, N, False, False, False, N, N, N, N),
    ("Batteries 24-pack fresh", "Home", N, 24, N, False, False, False, N, N, N, N),
    ("Pack of 6 mugs", "Home", N, 6, N, False, False, False, N, N, N, N),
    ("Resistors 500 pcs", "Electronics", N, 500, N, False, False, False, N, N, N, N),
    ("Lot (3) desk lamps", "Home", N, 3, N, False, False, False, N, N, N, N),
    ("Pack of 1 kettle bulk", "Home", N, N, N, False, False, False, N, N, N, N),
    ("Job lot fishing reels", "Sport", N, 2, N, False, False, False, N, N, N, N),
    ("A lot of fun board puzzle", "Toys", N, N, N, False, False, False, N, N, N, N),
    ("Vintage stamps", "Mixed Lots", N, 2, N, False, False, False, N, N, N, N),
    ("Nintendo Switch OLED console only", "Consoles", N, N, "bare", False, False, False, N, N, N, "switch-oled"),
    ("Handheld without charger", "Consoles", N, N, "bare", False, False, False, N, N, N, N),
    ("PS5 bundle two pads", "Consoles", N, N, "bundle", False, False, False, N, N, N, "ps5"),
    ("Camera kit with strap", "Cameras", N, N, "complete", False, False, False, N, N, N, N),
    ("Works with older cars", "Auto", N, N, N, False, False, False, N, N, N, N),
    ("Drawing tablet and dock and hdmi cord", "Tablets", N, N, "complete", False, False, False, N, N, N, N),
    ("Switch Lite + carrying pouch", "Consoles", N, N, "complete", False, False, False, N, N, N, "switch-lite"),
    ("RTX 3080 for parts", "Graphics Cards", N, N, N, True, False, False, N, N, N, "rtx-3080"),
    ("RTX 3080 Ti 12GB", "Graphics Cards", "Pour pièces détachées", N, N, True, False, False, 12, N, N, "rtx-3080-ti"),
    ("GTX 1080 untested", "Graphics Cards", N, N, N, True, False, False, N, N, N, "gtx-1080"),
    ("Laptop bad motherboard", "Laptops", N, N, N, True, False, False, N, N, N, N),
    ("RX 6800 XT gpu and memory missing", "Graphics Cards", N, N, N, True, False, False, N, N, N, "rx-6800-xt"),
    ("Motherboard no ram", "Motherboards", N, N, "bare", True, False, False, N, N, N, N),
    ("Gaming pc tower no ram", "Memory", N, N, "bare", False, False, False, N, N, N, N),
    ("Phone case free screen no cracks", "Phones", N, N, N, False, False, False, N, N, N, N),
    ("Old phone cracking glass", "Phones", N, N, N, True, False, False, N, N, N, N),
    ("Monitor DOA", "Monitors", N, N, N, True, False, False, N, N, N, N),
    ("Fresh desktop processor i7-9700K", "CPUs/Processors", N, N, N, False, False, False, N, N, N, "i7-9700k"),
    ("Ryzen 7 5800X3D boxed cpu", "CPUs/Processors", N, N, N, False, False, False, N, N, N, "ryzen-5800x3d"),
    ("3700X ryzen chip", "CPUs/Processors", N, N, N, False, False, False, N, N, N, "ryzen-3700x"),
    ("Backplate for RTX 3090", "Graphics Cards", N, N, N, False, True, False, N, N, N, "rtx-3090"),
    ("RTX 3090 with backplate", "Graphics Cards", N, N, N, False, False, False, N, N, N, "rtx-3090"),
    ("RTX 4070 empty box", "Graphics Cards", N, N, N, False, True, False, N, N, N, "rtx-4070"),
    ("RTX 2070 cooler only", "Graphics Cards", N, N, N, False, True, False, N, N, N, "rtx-2070"),
    ("Heat sink thing", "Computer Cooling", N, N, N, False, True, False, N, N, N, N),
    ("Boxed shell, no gpu", "Graphics Cards", N, N, "bare", True, True, False, N, N, N, N),
    ("Sticker for a laptop lid", "Stationery", N, N, N, False, True, False, N, N, N, N),
    ("Sleeve for a tablet", "Fashion", N, N, N, False, True, False, N, N, N, N),
    ("Nintendo Switch dock", "Consoles", N, N, N, False, True, False, N, N, N, "switch"),
    ("Nintendo Switch 2 in white", "Consoles", N, N, N, False, False, False, N, N, N, "switch-2"),
    ("Memory 2x16GB DDR4 UDIMM", "Memory (RAM)", N, N, N, False, False, False, 32, "DDR4", "desktop", N),
    ("Kit 32GB x 2 DDR5 SODIMM memory", "Memory (RAM)", N, N, N, False, False, False, 64, "DDR5", "laptop", N),
    ("Laptop 64GB RAM 2x2TB SSD", "PC Laptops & Netbooks", N, N, N, False, False, False, 64, N, "laptop", N),
    ("RTX 3090 24GB x 2", "Graphics Cards", N, N, N, False, False, False, 24, N, N, "rtx-3090"),
    ("NVMe drive 1TB M.2 PCIe 4.0", "SSD", N, N, N, False, False, False, 1024, "PCIE4", "m.2", N),
    ("SATA SSD 2.5 inch 480GB", "SSD", N, N, N, False, False, False, 480, N, "2.5in", N),
    ("ECC registered memory 16GB", "Memory (RAM)", N, N, N, False, False, False, 16, N, "server", N),
    ("Gen 5 ssd storage 2TB", "SSD", N, N, N, False, False, False, 2048, "PCIE5", N, N),
    ("Shoes with 2.5 inch heel", "Fashion", N, N, N, False, False, False, N, N, N, N),
    ("iPhone 13 Pro Max 256GB", "Cell Phones & Smartphones", N, N, N, False, False, False, 256, N, N, "iphone-13-promax"),
    ("iPhone 16e 128GB", "Cell Phones & Smartphones", N, N, N, False, False, False, 128, N, N, "iphone-16e"),
    ("iPhone SE 2 64GB", "Cell Phones & Smartphones", N, N, N, False, False, False, 64, N, N, "iphone-se2"),
    ("Galaxy S 23 Ultra", "Cell Phones & Smartphones", N, N, N, False, False, False, N, N, N, "galaxy-s23-ultra"),
    ("Galaxy S22+ phone", "Cell Phones & Smartphones", N, N, N, False, False, False, N, N, N, "galaxy-s22"),
    ("Pixel 8 Pro black / white / blue", "Cell Phones & Smartphones", N, N, N, False, False, True, N, N, N, "pixel-8-pro"),
    ("Phone 64/128/256GB", "Cell Phones & Smartphones", N, N, N, False, False, True, 256, N, N, N),
    ("Console 512GB or 1TB", "Video Game Consoles", N, N, N, False, False, True, 1024, N, N, N),
    ("Desktop 512GB 16GB 32GB", "PC Desktops", N, N, N, False, False, False, 512, N, N, N),
    ("Choose your colour scarf", "Fashion", N, N, N, False, False, True, N, N, N, N),
    ("Xbox Series X", "Consoles", N, N, N, False, False, False, N, N, N, "xbox-series-x"),
    ("Xbox One disc title", "Video Games", N, N, N, False, False, False, N, N, N, N),
    ("Playstation 4 slim", "Consoles", N, N, N, False, False, False, N, N, N, "ps4"),
    ("Plain wooden chair", "Home", N, N, N, False, False, False, N, N, N, N),
]
COLUMNS = "title_id int, title string, category string, condition string, lot_size int, completeness string, has_defect boolean, is_accessory boolean, price_is_from boolean, capacity_gb int, spec_generation string, form_factor string, model_key string"


def titled(spark: SparkSession, sf: str) -> DataFrame:
    """A title for every order, by its key; the bank is a fixed small table."""
    bank = spark.createDataFrame([(i, *row[:3]) for i, row in enumerate(BANK)], "title_id int, title string, category string, condition string")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("listing_id"), (F.col("o_orderkey") % len(BANK)).cast("int").alias("title_id"))
    return orders.join(F.broadcast(bank), "title_id")


def _fields(*names: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return extract.extracted(titled(spark, sf)).select("listing_id", *names)

    return query


def extract_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = titled(spark, sf)
    none = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in zip(extract.FIELDS, ("int", "string", "boolean", "boolean", "boolean", "int", "string", "string", "string"), strict=True)])
    return extract.report(extract.extracted(rows).withColumn("before", none))


def _sql(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"


_NAMES = "title_id, title, category, condition, " + ", ".join(extract.FIELDS)
_BANK = f"with bank({_NAMES}) as (values " + ", ".join("(" + ", ".join(map(_sql, (i, *row))) + ")" for i, row in enumerate(BANK)) + f"),\nx as (select o_orderkey as listing_id, bank.* from orders join bank on title_id = o_orderkey % {len(BANK)})\n"
_GROUPS = {"extract_lots": ("lot_size",), "extract_completeness": ("completeness",), "extract_defects": ("has_defect",), "extract_accessories": ("is_accessory",), "extract_variants": ("price_is_from",), "extract_capacity": ("capacity_gb",), "extract_memory": ("spec_generation", "form_factor"), "extract_model_key": ("model_key",)}
SQL = {name: _BANK + f"select listing_id, {', '.join(cols)} from x" for name, cols in _GROUPS.items()}
SQL["extract_usable"] = _BANK + "select listing_id, lot_size is null and not has_defect and not is_accessory and not price_is_from as usable_as_comp from x"
SQL["extract_report"] = _BANK + """select count(*) as processed, count(lot_size) as lots, count(*) filter (where has_defect) as defects, count(*) filter (where is_accessory) as accessories, count(*) filter (where price_is_from) as multi_variant,
  count(*) filter (where completeness = 'bare') as bare, count(*) filter (where completeness = 'complete') as complete, count(*) filter (where completeness = 'bundle') as bundle, count(*) as changed,
  count(lot_size) + count(*) filter (where has_defect) + count(*) filter (where is_accessory) + count(*) filter (where price_is_from) as excluded_from_comps from x"""
QUERIES = {name: _fields(*cols) for name, cols in _GROUPS.items()} | {"extract_usable": _fields("usable_as_comp"), "extract_report": extract_report}
