"""Settings of the analytics. Thresholds, confidences and word lists."""

from dataclasses import dataclass

TXN_WORDS = ("TRANSFER", "TXN", "MONEY", "PAYMENT", "TRANSACTION")
#: The graph analytics and the detectors differ in what they take for a call.
GRAPH_CALL_WORDS = ("CALL", "CDR", "PHONE", "CONTACT")
CALL_WORDS = ("CALL", "CDR", "PHONE", "CONTACT", "USES")
HONORIFICS = ("shri", "smt", "smti", "dr", "md", "mohammad", "mohd", "mr", "mrs", "ms", "sri", "shree", "late", "adv", "prof")
GENESIS = "0" * 64
SEVERITY = {"P1_circular_flow": "high", "P2_burner_hub": "high", "P3_call_then_transfer": "medium", "P4_comm_burst": "medium"}
EDGE_CONFIDENCE = {"fir": 0.85, "cdr": 0.92, "txn": 0.88, "structured": 0.88, "observed": 0.85, "communicates": 0.8, "case": 0.9, "uses_text": 0.75, "uses_anchor": 0.9, "associated": 0.6}
EXTRACTION_CONFIDENCE = {"phone": 0.98, "vehicle": 0.97, "person": 0.55}


@dataclass(frozen=True)
class Detection:
    cycle_min: int = 3
    cycle_max: int = 5
    cycle_days: int = 30
    hub_peers: int = 4
    hub_days: int = 45
    follow_hours: int = 72
    follow_hits: int = 3
    burst_days: int = 7
    burst_z: float = 4.0
    amount_z: float = 3.5
    volume_z: float = 3.5
    volume_peak: int = 8
    expand_days: int = 7
    expand_new: int = 5
    expand_times: float = 3.0
    odd_from: int = 0
    odd_to: int = 5
    odd_total: int = 8
    odd_ratio: float = 0.3
    odd_times: float = 3.0
    own_baseline: int = 5


@dataclass(frozen=True)
class Resolution:
    merge: float = 85.0
    review: float = 60.0
    name_only: float = 95.0
    phone_confidence: float = 0.95
    vehicle_confidence: float = 0.90
