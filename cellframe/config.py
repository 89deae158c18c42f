"""Job parameters.

Fixed values that must equal the reference pipeline's defaults are kept
together below; everything else is a parameter with a default chosen so
the test tables are meaningful (see FIXTURES.md).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values (must equal the reference's defaults) -------------------
PAD_TOKEN_ID = 0          # gene id used for padding and for unknown genes
PAD_VALUE = -2.0          # expression value used for padding
N_BINS = 101              # categorical value vocabulary (bins 0..100 + pad)
BIN_EDGES = 100           # number of linspace edges used for binning
CLS_VALUE = 0.0           # value placed in front of a sequence with <cls>
CLS_ID_DEFAULT = 185621   # <cls> id when no gene vocabulary is supplied
SEQ_LENGTH_DEFAULT = 1500
SAMPLE_PROPORTION = 0.75  # share of L drawn when a cell has more than L genes
MASK_RATIO = 0.15
MASK_VALUE = -1.0
BATCH_SIZE = 64
LOG_INTERVAL = 100
CHUNK_ROWS = 500_000
SIMILARITY_TEMPERATURE = 0.5
RELATIVE_ERROR_EPS = 1e-6
MODEL_NTOKEN = 185622
MODEL_N_TYPES = 44
MODEL_N_BATCHES = 238
# cell types dropped before encoding (null types are kept)
CELLTYPE_DENYLIST = (
    "Unknow", "S phase", "G2/M phase", "G1/G0 phase", "G1/S phase", "G1 phase",
    "Contaminating nuclei", "Contamination", "Stress response", "Transitory",
    "Outer cell layer", "Inner cell layer", "Middle cell layer", "Vascular tissue",
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Parameters of one build/analysis job."""

    seq_length: int = 40
    seed: int = 1234
    n_edges: int = BIN_EDGES
    pad_id: int = PAD_TOKEN_ID
    pad_value: float = PAD_VALUE
    sample_proportion: float = SAMPLE_PROPORTION
    denylist: tuple = field(default=CELLTYPE_DENYLIST)
    test_size: float = 0.1
    valid_size: float = 0.5
    chunk_rows: int = CHUNK_ROWS
    mask_ratio: float = MASK_RATIO
    mask_value: float = MASK_VALUE
    cos_threshold: float = 0.3
    knn_k: int = 20
    top_k: int = 10
    resolution: float = 0.8
    batch_size: int = BATCH_SIZE
    log_interval: int = LOG_INTERVAL

    @property
    def sample_size(self) -> int:
        return int(self.seq_length * self.sample_proportion)
