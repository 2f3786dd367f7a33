from .log import (append_claims, load_versions, read_claims, read_jdbc, read_log,
                  read_snapshot, refresh_all, refresh_table, write_snapshot)
from .revocations import (append_indexed, read_revocations, revocations_of,
                          write_revocations)

__all__ = ["append_claims", "append_indexed", "load_versions", "read_claims", "read_jdbc",
           "read_log", "read_revocations", "read_snapshot", "refresh_all", "refresh_table",
           "revocations_of", "write_revocations", "write_snapshot"]
