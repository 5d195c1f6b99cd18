"""Audit of telemetry calls in large collections of source code, on Spark DataFrames."""

from beaconaudit.operators.findings import detect
from beaconaudit.plans.scan import ScanResult, scan, scan_directories, scan_files
from beaconaudit.rules import LEGACY, LEGACY_DETAILED, LIVE, LIVE_SPLIT_IMPORTS, Rulebook, register_rules

__all__ = ["LEGACY", "LEGACY_DETAILED", "LIVE", "LIVE_SPLIT_IMPORTS", "Rulebook", "ScanResult", "detect",
           "register_rules", "scan", "scan_directories", "scan_files"]
