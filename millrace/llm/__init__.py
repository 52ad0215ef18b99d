"""Operations of a training-data pipeline: sharding, mixing, licence scans, near-duplicates,
tokenisation, language identification, web archives, binary-code search, fingerprints, personal
data, nearest neighbours, fill-in-the-middle and clusters. Nothing outside this subpackage imports
it."""
