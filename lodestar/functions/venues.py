"""Venue presets."""

# Names of journal families and preprint servers.
NATURE = (
    "Nature",
    "Nature Africa",
    "Nature Aging",
    "Nature Astronomy",
    "Nature Biomedical Engineering",
    "Nature Biotechnology",
    "Nature Cancer",
    "Nature Cardiovascular Research",
    "Nature Catalysis",
    "Nature Cell Biology",
    "Nature Chemical Biology",
    "Nature Chemical Engineering",
    "Nature Chemistry",
    "Nature Cities",
    "Nature Climate Change",
    "Nature Communications",
    "Nature Computational Science",
    "Nature Digest",
    "Nature Ecology & Evolution",
    "Nature Electronics",
    "Nature Energy",
    "Nature Food",
    "Nature Genetics",
    "Nature Geoscience",
    "Nature Health",
    "Nature Human Behaviour",
    "Nature Immunology",
    "Nature India",
    "Nature Italy",
    "Nature Machine Intelligence",
    "Nature Materials",
    "Nature Mechanical Engineering",
    "Nature Medicine",
    "Nature Mental Health",
    "Nature Metabolism",
    "Nature Methods",
    "Nature Microbiology",
    "Nature Nanotechnology",
    "Nature Neuroscience",
    "Nature Photonics",
    "Nature Physics",
    "Nature Plants",
    "Nature Progress Brain Health",
    "Nature Progress Oncology",
    "Nature Protocols",
    "Nature Reviews Biodiversity",
    "Nature Reviews Bioengineering",
    "Nature Reviews Cancer",
    "Nature Reviews Cardiology",
    "Nature Reviews Chemistry",
    "Nature Reviews Clean Technology",
    "Nature Reviews Clinical Oncology",
    "Nature Reviews Computing",
    "Nature Reviews Disease Primers",
    "Nature Reviews Drug Discovery",
    "Nature Reviews Earth & Environment",
    "Nature Reviews Electrical Engineering",
    "Nature Reviews Endocrinology",
    "Nature Reviews Gastroenterology & Hepatology",
    "Nature Reviews Genetics",
    "Nature Reviews Immunology",
    "Nature Reviews Materials",
    "Nature Reviews Methods Primers",
    "Nature Reviews Microbiology",
    "Nature Reviews Molecular Cell Biology",
    "Nature Reviews Nephrology",
    "Nature Reviews Neurology",
    "Nature Reviews Neuroscience",
    "Nature Reviews Physics",
    "Nature Reviews Psychology",
    "Nature Reviews Rheumatology",
    "Nature Reviews Urology",
    "Nature Sensors",
    "Nature Structural & Molecular Biology",
    "Nature Sustainability",
    "Nature Synthesis",
    "Nature Water",
)
SCIENCE = (
    "Science",
    "Science Advances",
    "Science Immunology",
    "Science Robotics",
    "Science Signaling",
    "Science Translational Medicine",
)
CELL = (
    "Cell",
    "Cancer Cell",
    "Cell Biomaterials",
    "Cell Chemical Biology",
    "Cell Genomics",
    "Cell Host & Microbe",
    "Cell Metabolism",
    "Cell Press Blue",
    "Cell Reports",
    "Cell Reports Medicine",
    "Cell Reports Methods",
    "Cell Reports Physical Science",
    "Cell Reports Sustainability",
    "Cell Stem Cell",
    "Cell Systems",
)
PREPRINT = (
    "arXiv",
    "arXiv.org",
    "bioRxiv",
    "medRxiv",
    "ChemRxiv",
    "SSRN",
    "TechRxiv",
    "Research Square",
    "Preprints",
    "Preprints.org",
    "OSF Preprints",
)
VENUE_PRESETS = {"nature": NATURE, "science": SCIENCE, "cell": CELL, "preprint": PREPRINT}
