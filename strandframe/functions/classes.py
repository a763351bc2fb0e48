"""Classes of RNA genes by name and of pseudogenes by biotype."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Per biotype, subclass names with the pattern that a gene name must start with; the first one counts.
RNA_SUBCLASSES = {
    "rRNA": {"RNA5SP{n}": r"RNA5SP([0-9])([0-9]+)", "RNA5S{n}": r"RNA5S([0-9]+)", "RNA5-8S[NP]{n}": r"RNA5-8S([NP])([0-9]+)", "5_8S_rRNA": r"5_8S_rRNA", "5S_rRNA": r"5S_rRNA"},
    "lncRNA": {
        "TTTY": r"TTTY([0-9][AB]?)",
        "gene + LP{n}": r"([A-Z0-9]+)([PL][0-9])",
        "idot": r"([A-Z0-9orf\-]+)-[IDO]T([0-9]?)",
        "long intergenic noncoding": r"LINC([0-9]+)",
        "long intergenic noncoding 2": r"([A-Z0-9]+)LNC",
        "long intergenic noncoding 3": r"LNC([A-Z0-9]+)",
        "antisense": r"([A-Z0-9orf\-]+)-?AS([0-9]?)",
        "micro RNA": r"MIR([A-Z0-9]+)",
        "U RNA": r"RNU([A-Z0-9\-]+)",
        "orf": r"([A-Z0-9]+orf[A-Z0-9]+)",
    },
    "snRNA": {"RNU": r"RNU([12467]|5[A-F])-?([0-9]+)(P)?", "RNVU": r"RNVU1-([0-9]{1,2})", "RNU + ATAC": r"RNU([46])ATAC([0-9]{1,2}P)?", "RN7SK": r"RN7SK", "RNU6V": r"RNU6V", "U": r"U([12467])"},
    "snoRNA": {"SNO": r"SNOR([AD])([0-9]{1,3})([A-Z]?)", "SCA": r"SCARNA(10|12|18)(B?)", "U": r"U([38])", "RNU": r"RNU105([BC])", "snoZ196": r"snoZ196"},
    "miRNA": {"MIR": r"MIR([0-9]+)-?([1-9])?", "MIRLET7": r"MIRLET7([A-I])([1-3])?", "SNORD138": r"SNORD138", "hsa-mir-8069-1": r"hsa-mir-8069-1"},
    "scaRNA": {"SCA": r"SCARNA([0-9]+)(B)?"},
    "scRNA": {"BCYRN1": r"BCYRN1"},
    "vault_RNA": {"VT": r"VTRNA([0-9])-([0-9])(P)?"},
    "misc_RNA": {"RN7SL(P)": r"RN7SL([0-9]+)(P)?", "RNY": r"RNY([134])(P[1-9])?", "VT": r"VTRNA([0-9])-([0-9])(P)?", "Y_RNA": r"Y_RNA", "7SK": r"7SK", "Vault": r"Vault", "Metazoa_SRP": r"Metazoa_SRP", "Telomerase-vert": r"Telomerase-vert", "NRON": r"NRON"},
}
# Acronyms and the word of the biotype that each stands for, in three groups; one of each group counts.
PSEUDOGENE_PARTS = (
    (("TC", "transcribed"), ("TL", "translated")),
    (("UP", "unprocessed"), ("P", "processed"), ("U", "unitary"), ("IG", "IG"), ("TR", "TR"), ("rRNA", "rRNA")),
    (("C", "C"), ("J", "J"), ("V", "V"), ("D", "D")),
)


def rna_subclass(biotype: Column, name: Column) -> Column:
    """The subclass of an RNA gene; null for a name or biotype that no pattern knows. The pseudogenes of ribosomal
    RNA share its patterns."""
    kind = F.when(biotype == "rRNA_pseudogene", "rRNA").otherwise(biotype)
    out = F.lit(None).cast("string")
    for wanted, patterns in reversed(RNA_SUBCLASSES.items()):
        one = F.lit(None).cast("string")
        for label, pattern in reversed(patterns.items()):
            one = F.when(name.rlike(f"^(?:{pattern})"), label).otherwise(one)
        out = F.when(kind == wanted, one).otherwise(out)
    return out


def pseudogene_acronym(biotype: Column) -> Column:
    """Acronym parts joined by '_'; empty for a biotype without any of the words."""
    parts = []
    for group in PSEUDOGENE_PARTS:
        one = F.lit(None).cast("string")
        for acronym, word in reversed(group):
            one = F.when(F.contains(biotype, F.lit(word)), acronym).otherwise(one)
        parts.append(one)
    return F.concat_ws("_", *parts)
