"""OME-XML descriptions, and sets of single-channel files."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import bag_digest
from ..functions.text import UNSAFE
from .sinks import write_tiff
from .storage import FormatError, split_uri

NAMESPACE = "http://www.openmicroscopy.org/Schemas/OME/2016-06"
PIXEL_TYPES = {8: "uint8", 16: "uint16"}


def ome_xml(name: str, *, width: int, height: int, channels: Iterable[dict], z: int = 1, t: int = 1, bits: int = 8, mpp: tuple[float, float] = (0.0, 0.0), rgb: bool = False) -> str:
    """Description of one image. channels have name, color (r, g, b), and optionally fluor, excitation_nm, emission_nm, exposure_s."""
    channels = list(channels)
    root = ET.Element("OME", xmlns=NAMESPACE)
    image = ET.SubElement(root, "Image", ID="Image:0", Name=name)
    sizes = {"SizeX": width, "SizeY": height, "SizeC": 3 if rgb else max(1, len(channels)), "SizeZ": z, "SizeT": t}
    pixels = ET.SubElement(image, "Pixels", ID="Pixels:0", DimensionOrder="XYCZT", Type=PIXEL_TYPES[bits], SignificantBits=str(bits), **{k: str(v) for k, v in sizes.items()})
    for axis, value in zip("XY", mpp):
        if value > 0:
            pixels.set(f"PhysicalSize{axis}", repr(value))
            pixels.set(f"PhysicalSize{axis}Unit", "µm")
    if rgb:
        ET.SubElement(pixels, "Channel", ID="Channel:0:0", SamplesPerPixel="3")
    for i, c in enumerate([] if rgb else channels):
        r, g, b = c.get("color") or (255, 255, 255)
        packed = (r << 24) | (g << 16) | (b << 8) | 255
        e = ET.SubElement(pixels, "Channel", ID=f"Channel:0:{i}", Name=c["name"], SamplesPerPixel="1", Color=str(packed - (1 << 32) if packed >= 1 << 31 else packed))
        for key, attribute in (("fluor", "Fluor"), ("excitation_nm", "ExcitationWavelength"), ("emission_nm", "EmissionWavelength")):
            if c.get(key):
                e.set(attribute, str(c[key]))
                if attribute != "Fluor":
                    e.set(attribute + "Unit", "nm")
    ET.SubElement(pixels, "TiffData")
    for i, c in enumerate([] if rgb else channels):
        if c.get("exposure_s") is not None:
            ET.SubElement(pixels, "Plane", TheC=str(i), TheZ="0", TheT="0", ExposureTime=repr(float(c["exposure_s"])), ExposureTimeUnit="s")
    return '<?xml version="1.0" encoding="UTF-8"?>' + ET.tostring(root, encoding="unicode")


def safe_name(value: str) -> str:
    return re.sub(r"\s+", "_", re.sub(UNSAFE, "_", value)).strip("._")


def channel_name(number: int, channel: dict) -> str:
    """Cnn_name, counted from 1; Cnn for a channel without a name of its own."""
    known = "" if channel.get("identity_source") == "unknown" else safe_name(str(channel.get("fluor") or channel.get("name") or ""))
    return f"C{number:02d}" + (f"_{known}" if known else "")


def reserve(folder: str, stem: str, channels: list[dict]) -> tuple[str, list[str]]:
    """Names of a set that are all free: the description's, and one for each channel. The set as a whole gets a suffix if any is taken."""
    n = 0
    while True:
        base = stem if not n else f"{stem}_{n}"
        parts = [f"{base}_{channel_name(i, x)}.svs" for i, x in enumerate(channels, 1)]
        every = [f"{base}.afi", *parts]
        if not any(os.path.exists(os.path.join(folder, x)) for e in every for x in (e, e + ".part")):
            return every[0], parts
        n += 1


def write_channel_set(tiles: DataFrame, path: str, channels: list[dict]) -> list[str]:
    """A file set: one TIFF for each channel of tiles (with a column channel), then the XML that names them.

    All files are written to a staging folder and put in place only when every one is complete; a
    failure leaves nothing behind. Channels must agree in their geometry."""
    system, local = split_uri(path)
    if system is not None:
        raise FormatError("remote_sink", "write", "file sets are written to mounted folders")
    folder, stem = os.path.dirname(local) or ".", os.path.basename(local).removesuffix(".afi")
    shapes = tiles.groupBy("channel").agg(bag_digest("level", "y", "x", "w", "h").alias("shape"))
    facts = shapes.agg((F.min("shape") == F.max("shape")).alias("agree"), F.count(F.lit(1)).alias("channels")).first()
    if not facts["agree"] or facts["channels"] != len(channels):
        raise FormatError("afi_channels_disagree", "geometry")
    os.makedirs(folder, exist_ok=True)
    xml_name, names = reserve(folder, stem, channels)
    staging = os.path.join(folder, f".{xml_name}.staging")
    placed: list[str] = []
    try:
        for i, c in enumerate(channels):
            r, g, b = c.get("color") or (255, 255, 255)
            text = f"Aperio Image Library\r\nJPEG/Monochrome|Dye = {c['name']}|DisplayColor = {(r << 16) | (g << 8) | b}"
            text += f"|Exposure Time = {c['exposure_s']}" if c.get("exposure_s") is not None else ""
            write_tiff(tiles.where(F.col("channel") == i).withColumn("slide_id", F.lit(f"c{i}")), staging, description=text)
        for i, name in enumerate(names):
            os.replace(os.path.join(staging, f"c{i}.tif"), os.path.join(folder, name))
            placed.append(os.path.join(folder, name))
        root = ET.Element("AFI")
        for name in names:
            ET.SubElement(root, "Path").text = name
        part = os.path.join(folder, xml_name + ".part")
        ET.ElementTree(root).write(part, encoding="utf-8", xml_declaration=True)
        os.replace(part, os.path.join(folder, xml_name))
        return [os.path.join(folder, xml_name), *placed]
    except BaseException:
        for f in placed:
            os.unlink(f)
        raise
    finally:
        import shutil

        shutil.rmtree(staging, ignore_errors=True)
