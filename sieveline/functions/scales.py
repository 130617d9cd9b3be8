"""Residue scales, motif lists, allele frequencies and other fixed values of the screening rules."""

from __future__ import annotations

# Fixed values, taken from the published scales that the screening rules are defined on.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
FLEXIBILITY = {
    "A": 0.81, "R": 0.81, "N": 0.88, "D": 0.63, "C": 0.81, "Q": 0.88, "E": 0.88, "G": 0.43, "H": 0.74, "I": 0.94,
    "L": 0.94, "K": 0.81, "M": 0.81, "F": 0.84, "P": 0.57, "S": 0.63, "T": 0.76, "W": 0.74, "Y": 0.88, "V": 0.91,
}
HYDROPHILICITY = {
    "A": 0.35, "R": 0.79, "N": 0.72, "D": 0.72, "C": 0.24, "Q": 0.71, "E": 0.71, "G": 0.43, "H": 0.58, "I": 0.07,
    "L": 0.10, "K": 0.73, "M": 0.20, "F": 0.20, "P": 0.36, "S": 0.62, "T": 0.58, "W": 0.20, "Y": 0.43, "V": 0.29,
}
BETA_TURN = {
    "A": 0.66, "R": 0.72, "N": 0.73, "D": 0.67, "C": 0.74, "Q": 0.73, "E": 0.71, "G": 0.88, "H": 0.74, "I": 0.66,
    "L": 0.71, "K": 0.68, "M": 0.68, "F": 0.71, "P": 1.00, "S": 0.82, "T": 0.80, "W": 0.71, "Y": 0.72, "V": 0.69,
}
ACCESSIBILITY = {aa: 0.67 if aa in "NDQEST" else 0.59 for aa in RESIDUES}
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
MEMBRANE_HYDROPATHY = {aa: v for aa, v in HYDROPATHY.items() if aa != "M"}  # methionine doesn't count for membrane helices
AGGREGATION_HYDROPATHY = {aa: HYDROPATHY[aa] for aa in "IVLFWMCATS"}
#: helix, sheet, coil, turn propensities
PROPENSITY = {
    "A": (1.45, 0.97, 0.78, 0.58), "R": (0.79, 0.88, 0.92, 0.65), "N": (0.73, 0.86, 1.04, 1.23), "D": (0.71, 0.85, 0.83, 1.19),
    "C": (1.20, 0.75, 0.83, 0.71), "Q": (1.11, 0.88, 0.81, 1.05), "E": (1.06, 0.94, 0.83, 1.02), "G": (0.38, 0.82, 0.94, 0.58),
    "H": (0.97, 0.86, 0.87, 1.00), "I": (1.61, 1.02, 0.75, 0.52), "L": (1.31, 0.91, 0.79, 0.57), "K": (0.79, 0.83, 0.91, 0.66),
    "M": (1.18, 0.90, 0.80, 0.59), "F": (1.13, 0.97, 0.83, 0.64), "P": (0.30, 0.62, 1.00, 0.48), "S": (0.79, 0.81, 0.96, 1.34),
    "T": (0.84, 0.76, 0.92, 0.94), "W": (1.14, 0.86, 0.83, 0.53), "Y": (0.86, 0.91, 0.88, 0.86), "V": (1.38, 0.91, 0.77, 0.55),
}
WEIGHTS = {
    "A": 89.09, "R": 174.20, "N": 132.12, "D": 133.10, "C": 121.15, "Q": 146.15, "E": 147.13, "G": 75.07, "H": 155.16, "I": 131.17,
    "L": 131.17, "K": 146.19, "M": 149.21, "F": 165.19, "P": 115.13, "S": 105.09, "T": 119.12, "W": 204.23, "Y": 181.19, "V": 117.15,
}
OTHER_WEIGHT = 110.0
#: hydrophobicity, polarity, charge, size, secondary structure: for the auto-covariance score
PROPERTIES = {
    "A": (0.24, 0.0, 0.0, 0.59, 0.36), "R": (-1.76, 0.0, 1.0, 0.74, 0.53), "N": (-0.64, 0.0, 0.0, 0.49, 0.46),
    "D": (-0.72, 0.0, -1.0, 0.62, 0.51), "C": (0.04, 0.0, 0.0, 0.29, 0.35), "Q": (-0.69, 0.0, 0.0, 0.54, 0.49),
    "E": (-0.62, 0.0, -1.0, 0.68, 0.50), "G": (0.16, 0.0, 0.0, 0.48, 0.54), "H": (-0.40, 0.0, 0.5, 0.60, 0.32),
    "I": (0.94, 0.0, 0.0, 0.47, 0.46), "L": (0.74, 0.0, 0.0, 0.53, 0.37), "K": (-1.10, 0.0, 1.0, 0.74, 0.47),
    "M": (0.64, 0.0, 0.0, 0.60, 0.30), "F": (1.19, 0.0, 0.0, 0.40, 0.31), "P": (-0.07, 0.0, 0.0, 0.51, 0.51),
    "S": (-0.26, 0.0, 0.0, 0.55, 0.51), "T": (-0.18, 0.0, 0.0, 0.52, 0.44), "W": (0.81, 0.0, 0.0, 0.37, 0.31),
    "Y": (0.26, 0.0, 0.0, 0.47, 0.42), "V": (0.54, 0.0, 0.0, 0.50, 0.39),
}
#: strand propensities of the aggregation estimate; other residues 1.0. Fixed values
STRAND_PROPENSITY = {"V": 1.70, "I": 1.61, "Y": 1.29, "F": 1.19, "A": 0.92, "T": 0.87, "S": 0.79, "E": 0.67, "M": 0.80, "K": 0.64}
#: helix propensities of the stability estimate; other residues 1.0. Fixed values
HELIX_PROPENSITY = {"E": 1.55, "A": 1.45, "L": 1.40, "M": 1.33, "K": 1.07, "Q": 1.10, "R": 0.99, "S": 0.79, "P": 0.00}
#: expected contact rates of residue pairs in alphabetical order; other pairs 1.0
CONTACT_EXPECTED = {
    "AA": 1.0, "AC": 0.8, "AD": 0.7, "AE": 0.7, "AF": 1.0, "AG": 1.2, "AH": 0.9, "AI": 1.1, "AK": 0.8, "AL": 1.1,
    "AM": 1.0, "AN": 0.85, "AP": 1.1, "AQ": 0.9, "AR": 0.85, "AS": 0.95, "AT": 1.0, "AV": 1.0, "AW": 0.95, "AY": 0.95,
    "CC": 1.0, "CD": 0.8, "CE": 0.85, "CF": 1.0, "CG": 1.1, "CH": 0.9, "CI": 1.1, "CK": 0.85, "CL": 1.1, "CM": 1.0,
    "CN": 0.85, "CP": 1.05, "CQ": 0.9, "CR": 0.8, "CS": 0.9, "CT": 1.0, "CV": 1.0, "CW": 0.95, "CY": 1.0,
}
#: pair energies, looked up with the pair in alphabetical order; other pairs 0
CONTACT_ENERGY = {
    "II": -1.2, "VV": -1.0, "LL": -1.1, "FF": -0.9, "IL": -1.15, "IV": -1.1, "LV": -1.05, "AV": -0.6, "AL": -0.65, "AI": -0.7,
    "DK": -1.8, "EK": -2.0, "DR": -1.8, "ER": -2.0, "KK": 2.5, "RR": 2.5, "DD": 1.5, "EE": 1.5, "KR": 2.0, "KS": 0.3, "RT": 0.3,
    "DN": 0.2, "SS": 0.3, "TT": 0.3, "NN": 0.5, "QQ": 0.5, "ST": 0.2, "NQ": 0.3,
}
ALLERGEN_MOTIFS = (r"(K|R)L\d{2}[ST]", r"[FW]x{0,1}[ED]x{0,1}[LIV]{2}", r"C\.\.C.{4,6}C")
ALLERGEN_DOMAINS = (
    "PF00017", "PF00078", "PF00089", "PF00101", "PF00111", "PF00153", "PF00205", "PF00218", "PF00280", "PF00303", "PF00440", "PF00471",
    "PF00528", "PF00682", "PF00722", "PF00952", "PF01361", "PF01612", "PF02047", "PF02183", "PF02302", "PF02341", "PF03368", "PF04141",
    "PF04165", "PF04218", "PF04562", "PF05075", "PF05834", "PF06416", "PF06655", "PF06839", "PF08263", "PF10208", "PF11214", "PF11250",
    "PF11291", "PF11349", "PF12106", "PF12364", "PF13937", "PF16881", "PF17039", "PF18041", "PF18940",
)
TOXIN_MOTIFS = (
    ("WGD[TSG]", 0.6), ("[TS]LD[GE]", 0.3), ("H[DN]GDS", 0.4), ("CD[LIVM]-[AG]-[ST]-[ST]", 0.45),
    ("[AP]-x{4}-[AP]-[LIVM]-[FY]-[AP]-[LIVM]", 0.4), ("STEH", 0.3), ("GIA[ED]VTLLLR", 0.7), ("[^P]{60,120}DWSH", 0.5),
)
IFN_MOTIFS = (
    ("([KR].{2}[DE])", 0.8), ("([ST].{2}[LIVM])", 0.6), ("([DE].{3}[DE])", 0.7), ("([ILVM]..[DE])", 0.5), ("KXK", 0.9),
    ("(P.xP{2,})", 0.8), ("([FL]..[FL]..[FL])", 0.7),
)
IL4_MOTIFS = (("([AG].{2}[ST])", 0.5), ("([FY]...[WY])", 0.6), ("(S.xS)", 0.4), ("([ED]...[ED])", 0.7), ("([AIL]x{2}[AIL])", 0.5))
IL10_MOTIFS = (("([RK].{2}[RK])", 0.4), ("([ST].x{3}[ST])", 0.3), ("([DE]...[AG])", 0.4), ("(G.x{3}G)", 0.5))
TAP_C_TERMINAL = {
    "L": 0.9, "M": 0.85, "F": 0.85, "I": 0.8, "V": 0.75, "W": 0.85, "Y": 0.8, "K": 0.8, "R": 0.75, "A": 0.6, "G": 0.5, "S": 0.5,
    "T": 0.5, "C": 0.5, "N": 0.4, "Q": 0.4, "H": 0.4, "D": 0.2, "E": 0.2, "P": 0.1,
}
TAP_SECOND = {"Y": 0.9, "F": 0.85, "M": 0.8, "L": 0.8, "W": 0.8, "I": 0.7, "V": 0.6}
#: allele family, preferred C-terminal residues, preferred second residues, base concentration; the first that matches counts
ANCHOR_RULES = (
    ("A*01", "YFL", "TS", 200), ("A*02", "LM", "SATV", 150), ("A*03", "KRY", "LVM", 180), ("A*11", "KR", "VLM", 170),
    ("A*23", "FWY", "LIVMT", 200), ("A*24", "YWV", "FYWHK", 200), ("A*26", "LIVMT", "STNQ", 250), ("A*30", "KR", "LIVMT", 220),
    ("A*31", "LIVMT", "STNQ", 230), ("A*32", "LIVMT", "STNQ", 220), ("A*33", "KR", "LIVMT", 230), ("A*68", "LM", "SATV", 180),
    ("B*07", "DE", "P", 180), ("B*08", "LF", "KR", 200), ("B*15", "LM", "STNQ", 220), ("B*27", "RKH", "STNQ", 150),
    ("B*35", "P", "STNQ", 200), ("B*37", "DE", "STNQ", 220), ("B*38", "LM", "STNQ", 220), ("B*39", "LM", "STNQ", 220),
    ("B*40", "ED", "LIVMT", 180), ("B*44", "DE", "LIVMT", 160), ("B*51", "P", "STNQ", 180), ("B*53", "P", "STNQ", 200),
    ("B*57", "TS", "STNQ", 160), ("B*58", "LM", "STNQ", 180),
)
ENZYMES = (
    ("EcoRI", "GAATTC"), ("BamHI", "GGATCC"), ("XhoI", "CTCGAG"), ("HindIII", "AAGCTT"), ("NdeI", "CATATG"), ("BglII", "AGATCT"),
    ("KpnI", "GGTACC"), ("SalI", "GTCGAC"), ("NotI", "GCGGCCGC"), ("XbaI", "TCTAGA"), ("SacI", "GAGCTC"),
)
#: localization label without punctuation and case, its category; others are "unknown"
LOCALIZATION_CATEGORY = {
    "outermembrane": "outer_membrane", "lipoprotein": "lipoprotein", "cellwallanchored": "cell_wall_anchored",
    "wallanchored": "cell_wall_anchored", "cellwall": "cell_wall", "cellwallextracellular": "cell_wall", "cellwallmembrane": "cell_wall",
    "extracellular": "extracellular", "secreted": "secreted", "cytoplasmicmembrane": "cytoplasmic_membrane",
    "cytoplasmic": "intracellular", "cytosol": "intracellular", "cytoplasm": "intracellular",
}
SURFACE_CATEGORIES = ("outer_membrane", "lipoprotein", "cell_wall_anchored", "cell_wall", "extracellular", "secreted", "cytoplasmic_membrane")
LINKERS = {"adjuvant": "EAAAK", "ctl": "AAY", "htl": "GPGPG", "bcell": "KK"}
CONSTRUCT_CAPS = {"CTL": 8, "HTL": 8, "BCELL": 5}
#: allele frequencies, 0 to 1
ALLELE_FREQUENCY = {
    "HLA-A*01:01": 0.064851,
    "HLA-A*02:01": 0.151113,
    "HLA-A*02:05": 0.015397,
    "HLA-A*03:01": 0.073932,
    "HLA-A*11:01": 0.085964,
    "HLA-A*23:01": 0.047445,
    "HLA-A*24:02": 0.074103,
    "HLA-A*25:01": 0.012000,
    "HLA-A*26:01": 0.030048,
    "HLA-A*29:02": 0.021000,
    "HLA-A*30:01": 0.037128,
    "HLA-A*30:02": 0.028000,
    "HLA-A*31:01": 0.025000,
    "HLA-A*32:01": 0.021582,
    "HLA-A*33:01": 0.018103,
    "HLA-A*33:03": 0.035112,
    "HLA-A*34:02": 0.012000,
    "HLA-A*66:01": 0.013000,
    "HLA-A*68:01": 0.019531,
    "HLA-A*68:02": 0.018000,
    "HLA-A*74:01": 0.014000,
    "HLA-A*80:01": 0.005000,
    "HLA-B*07:02": 0.078926,
    "HLA-B*08:01": 0.057192,
    "HLA-B*13:02": 0.019000,
    "HLA-B*14:01": 0.012000,
    "HLA-B*14:02": 0.018000,
    "HLA-B*15:01": 0.037690,
    "HLA-B*15:03": 0.015000,
    "HLA-B*15:17": 0.011000,
    "HLA-B*18:01": 0.028000,
    "HLA-B*27:02": 0.012000,
    "HLA-B*27:05": 0.025000,
    "HLA-B*35:01": 0.060600,
    "HLA-B*35:03": 0.015000,
    "HLA-B*37:01": 0.013000,
    "HLA-B*38:01": 0.011000,
    "HLA-B*39:01": 0.013000,
    "HLA-B*40:01": 0.037770,
    "HLA-B*40:02": 0.015000,
    "HLA-B*40:06": 0.012000,
    "HLA-B*41:01": 0.008000,
    "HLA-B*42:01": 0.010000,
    "HLA-B*44:02": 0.034204,
    "HLA-B*44:03": 0.041158,
    "HLA-B*45:01": 0.012000,
    "HLA-B*46:01": 0.015000,
    "HLA-B*47:01": 0.006000,
    "HLA-B*48:01": 0.010000,
    "HLA-B*49:01": 0.012000,
    "HLA-B*50:01": 0.009000,
    "HLA-B*51:01": 0.037553,
    "HLA-B*52:01": 0.015000,
    "HLA-B*53:01": 0.021540,
    "HLA-B*54:01": 0.012000,
    "HLA-B*55:01": 0.011000,
    "HLA-B*56:01": 0.009000,
    "HLA-B*57:01": 0.024492,
    "HLA-B*58:01": 0.027154,
    "HLA-B*59:01": 0.006000,
    "HLA-B*67:01": 0.008000,
    "HLA-B*73:01": 0.005000,
    "HLA-B*78:01": 0.006000,
    "HLA-B*81:01": 0.005000,
    "HLA-B*82:01": 0.004000,
    "HLA-C*01:02": 0.053632,
    "HLA-C*02:02": 0.037830,
    "HLA-C*03:03": 0.044817,
    "HLA-C*03:04": 0.071828,
    "HLA-C*04:01": 0.140270,
    "HLA-C*05:01": 0.047451,
    "HLA-C*06:02": 0.082006,
    "HLA-C*07:01": 0.104101,
    "HLA-C*07:02": 0.116665,
    "HLA-C*08:02": 0.036182,
    "HLA-C*12:03": 0.045630,
    "HLA-C*14:02": 0.015000,
    "HLA-C*15:02": 0.013000,
    "HLA-C*16:01": 0.012000,
    "HLA-C*17:01": 0.008000,
    "HLA-DRB1*01:01": 0.086511,
    "HLA-DRB1*01:02": 0.012000,
    "HLA-DRB1*03:01": 0.108814,
    "HLA-DRB1*04:01": 0.081627,
}

# --- fixed values -----------------------------------------------------------------------------------
#: dissociation of residues and ends
BASES = {"K": 10.0, "R": 12.0, "H": 5.98}
ACIDS = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_TERMINUS, C_TERMINUS = 7.5, 3.55
#: the standard genetic code, amino acids in the order of the bases T, C, A, G
GENETIC_CODE = {
    a + b + c: aa
    for (a, b, c), aa in zip(((a, b, c) for a in "TCAG" for b in "TCAG" for c in "TCAG"), "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", strict=True)
}
#: patterns of well adapted codons (X: any base)
ADAPTED_CODONS = {
    "e coli": ("GGX", "GAX", "GUX", "GCG", "GCC", "GCA", "CCX", "CGT", "CGC"),
    "yeast": ("GGX", "GAX", "GUX", "GCG", "GCC", "GCA", "GCT", "CCX", "AUU", "AGA", "AGG", "UUA", "UUG"),
    "human": ("GGX", "GAC", "GUU", "GCG", "GCC", "GCA", "GCT", "CCX", "AUU", "AGA", "AGG", "UUA", "CUG"),
}
