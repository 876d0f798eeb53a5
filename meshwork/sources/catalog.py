"""Registered datasets: the files that make them up, how a record is labelled, and what its columns may be."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Labelling:
    """Where ``y_multi`` and ``y_bin`` come from.

    ``classes`` is the column of class names.  ``flag`` is the column of 0 and
    1; without it a record is flagged unless its cleaned class is the normal
    one.  ``listed`` are all columns that hold labels.
    """

    classes: str
    flag: str | None
    listed: tuple[str, ...]


@dataclass(frozen=True)
class RawDataset:
    """What reading, labelling and profiling need to know.

    ``parts`` are (part, file): the part tells train rows from test rows.
    ``header`` names the columns of files that have none.  ``candidates`` are
    names that may be there, by role: ``time`` or ``entity``.
    """

    name: str
    parts: tuple[tuple[str, str], ...]
    labels: Labelling
    candidates: dict[str, tuple[str, ...]]
    header: tuple[str, ...] = ()

    def paths(self, folder: str) -> list[str]:
        return [f"{folder.rstrip('/')}/{file}" for _, file in self.parts]


# The header of the headerless files.
KDD_COLUMNS = (
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login",
    "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate",
    "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "label", "difficulty_level",
)

# Files, and names that may hold labels, times and entities.
TIMES = ("timestamp", "ts", "stime", "ltime")
DATASETS = {
    d.name: d
    for d in (
        RawDataset(
            "kdd",
            (("train_file", "kdd/KDDTrain+.txt"), ("test_file", "kdd/KDDTest+.txt")),
            Labelling("label", None, ("label", "difficulty_level")),
            {"time": TIMES, "entity": ("protocol_type", "service", "flag", "src_bytes", "dst_bytes", "src_ip", "dst_ip", "src_port", "dst_port", "sport", "dport", "state", "proto")},
            KDD_COLUMNS,
        ),
        RawDataset(
            "unsw-nb15",
            (("train_file", "unsw-nb15/UNSW_NB15_training-set.csv"), ("test_file", "unsw-nb15/UNSW_NB15_testing-set.csv")),
            Labelling("attack_cat", "label", ("label", "attack_cat")),
            {"time": TIMES, "entity": ("srcip", "dstip", "sport", "dport", "proto", "service", "state", "src_ip", "dst_ip", "src_port", "dst_port")},
        ),
        RawDataset(
            "ton-iot",
            (("single_file", "ton-iot/train_test_network.csv"),),
            Labelling("type", "label", ("label", "type")),
            {"time": TIMES, "entity": ("src_ip", "dst_ip", "srcip", "dstip", "src_port", "dst_port", "sport", "dport", "proto", "service", "state")},
        ),
    )
}


def dataset(name: str) -> RawDataset:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(DATASETS))}")
    return DATASETS[name]
