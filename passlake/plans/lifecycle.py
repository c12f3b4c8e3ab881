"""Queries of label lifecycles, promotion and historical search, over cases made of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.operators import lifecycle as lc
from passlake.operators.recognition import saved
from passlake.plans.queries import query
from passlake.views import table

#: The same text in Spark SQL and DuckDB, as the domain views. Rows that break each rule are among them.
DATASETS = """select c_custkey as dataset_id, case when c_custkey % 10 = 0 then 'SYNTHETIC' else 'ENGINEER_LABELLED' end as kind,
    case c_custkey % 12 when 0 then 'LOCKED' when 1 then 'IN_REVIEW' when 2 then 'RETIRED' else 'DRAFT' end as status from {customer}"""
CASES = """select l_orderkey * 10 + l_linenumber as case_id, min(o_custkey) as dataset_id, l_orderkey as project_id, cast(l_linenumber as bigint) as occurrence,
    case when l_orderkey % 203 = 0 and l_linenumber % 2 = 1 then 'HOLDOUT' when l_orderkey % 5 = 0 then 'VALIDATION' else 'CALIBRATION' end as split,
    case when min(l_partkey) % 41 > 0 then concat('h', cast(min(l_partkey) as string)) end as input_hash, min(l_partkey) as part, min(l_returnflag) as role, min(l_suppkey) as station_id
    from {lineitem} join {orders} on l_orderkey = o_orderkey group by l_orderkey, l_linenumber"""
REVISIONS = "select p_partkey * 10 + 1 as revision_id, p_partkey as design_id from {part}"
_OUTCOME = "case when k % 60 = 3 and r = 2 then 'MAYBE' when k % 9 = 1 then 'NO_CATALOG_MATCH' else 'match_design' end"


def _assertion(r: int) -> str:
    return f"""select {r} as r, case_id as k, case when part % 97 = 1 and {r} = 1 then part + 1 else part end as design, part from cases
        where case_id % {(61, 67, 7)[r]} <> {(0, 0, 1)[r]}"""


ASSERTIONS = f"""with cases as ({CASES}), a as ({' union all '.join(_assertion(r) for r in range(3))})
    select k * 4 + r as assertion_id, case when k % 71 = 1 and r = 0 then -k else k end as case_id, case when k % 73 = 1 and r = 0 then ' ' else concat('r', cast(r % 2 as string)) end as reviewer,
    {_OUTCOME} as outcome, case when k % 9 = 1 and not (k % 89 = 7) or k % 83 = 5 then null else design end as design_id,
    case when k % 9 = 1 then null when k % 101 = 3 then design * 10 + 11 else part * 10 + 1 end as revision_id, 'seen' as reason, case when k % 103 = 5 then 1.5 else (k % 100) / 100.0 end as confidence from a"""
ADJUDICATIONS = f"""with cases as ({CASES})
    select case_id as adjudication_id, case_id, case when case_id % 47 = 0 then 'UNRESOLVED' when case_id % 9 = 1 then 'NO_CATALOG_MATCH' else 'MATCH_DESIGN' end as outcome,
    case when case_id % 47 = 0 or case_id % 9 = 1 or case_id % 211 = 5 then null else part end as design_id, case when case_id % 47 = 0 or case_id % 9 = 1 then null when case_id % 223 = 3 then part * 10 + 11 else part * 10 + 1 end as revision_id
    from cases where case_id % 301 <> 0"""
_TABLES = ("customer", "lineitem", "orders", "part")
VIEWS = {"datasets": DATASETS, "cases": CASES, "revisions": REVISIONS, "assertions": ASSERTIONS, "adjudications": ADJUDICATIONS}


class Labels:
    """The views of one query. The cases come from a join of the two largest tables and the other views read them several times, so they are saved once; so are the answers that a query reads twice."""

    def __init__(self, s: SparkSession, d: str) -> None:
        self.session, self.tables = s, {t: table(s, d, t) for t in _TABLES}
        self.datasets, self.revisions = self._view(DATASETS), self._view(REVISIONS)
        self.cases = saved(self._view(CASES), "cases")
        self.tables["cases"] = self.cases
        self.assertions, self.adjudications = (self._view(v.replace(f"cases as ({CASES})", "cases as (select * from {cases})")) for v in (ASSERTIONS, ADJUDICATIONS))

    def _view(self, sql: str) -> DataFrame:
        return self.session.sql(sql, **{t: df for t, df in self.tables.items() if "{" + t + "}" in sql})

    def judged(self) -> DataFrame:
        return lc.judge_assertions(self.assertions, self.cases, self.datasets, self.revisions)

    def drafted(self) -> DataFrame:
        """Assertions that were taken while all datasets took labels."""
        drafts = self.datasets.withColumn("status", F.lit("DRAFT"))
        return lc.judge_assertions(self.assertions, self.cases, drafts, self.revisions).where("refused is null")

    def taken(self) -> DataFrame:
        """What later steps read of them."""
        return saved(self.drafted().select("case_id", "outcome", "design_id", "revision_id"), "taken")

    def decided(self, taken: DataFrame) -> DataFrame:
        """Adjudications of all cases."""
        return lc.judge_adjudications(self.adjudications, taken, self.cases, self.revisions)

    def reviewed(self, *columns: str) -> DataFrame:
        """The reviewed cases; of the given columns, if any."""
        rows = lc.review_labels(self.cases, self.drafted(), self.adjudications, self.revisions)
        return saved(rows.select(*columns) if columns else rows, "reviewed")


def usages(s: SparkSession, d: str) -> DataFrame:
    """Usages of the matched cases; every eleventh is stale."""
    labels = Labels(s, d)
    found = labels.reviewed().where("outcome = 'MATCH_DESIGN' and input_hash is not null").join(labels.datasets.select("dataset_id", "kind"), "dataset_id")
    status = F.when(F.col("case_id") % 11 == 0, "STALE_SOURCE").otherwise("CONFIRMED")
    return found.select(
        lc.usage_id(F.col("case_id"), F.col("design_id"), F.col("input_hash")).alias("usage_id"), "project_id", "occurrence", "design_id", "station_id",
        F.when(F.col("case_id") % 13 > 0, F.col("role")).alias("role"), status.alias("status"), "kind", F.when(F.col("station_id") % 3 > 0, F.col("station_id")).alias("assembly_id"),
    )


_WITH = ", ".join(f"{name} as ({VIEWS[name].replace('{', '').replace('}', '')})" for name in VIEWS)
_LABELS = "('MATCH_DESIGN', 'NO_CATALOG_MATCH', 'NOT_A_ROLLER', 'INSUFFICIENT_DRAWING_EVIDENCE', 'UNRESOLVED')"
_FOREIGN = "(x.revision_id is not null and (v.design_id is null or x.design_id is null or v.design_id <> x.design_id))"


def _judge_sql(mutable: str) -> str:
    return f"""select x.*, case when outcome is null or upper(outcome) not in {_LABELS} then 'UNSUPPORTED_OUTCOME' when coalesce(trim(reviewer), '') = '' or coalesce(trim(reason), '') = '' then 'REVIEWER_OR_REASON_MISSING'
      when upper(outcome) = 'MATCH_DESIGN' and x.design_id is null then 'MATCH_WITHOUT_DESIGN' when upper(outcome) <> 'MATCH_DESIGN' and x.design_id is not null then 'NEGATIVE_WITH_DESIGN'
      when coalesce(confidence, 0) not between 0 and 1 then 'CONFIDENCE_OUT_OF_RANGE' when c.case_id is null then 'CASE_NOT_FOUND' when {mutable} then 'DATASET_NOT_MUTABLE' end early, {_FOREIGN} other
      from assertions x left join revisions v using (revision_id) left join cases c on c.case_id = x.case_id left join datasets d on d.dataset_id = c.dataset_id"""


def _refused_sql(early: str) -> str:
    return f"""select * exclude (early, other), coalesce(early, case when assertion_id > min(assertion_id) filter (where early is null and not other) over (partition by case_id, reviewer)
      then 'REVIEWER_REPEATED' when other then 'REVISION_OF_OTHER_DESIGN' end) refused from ({early})"""


_REVIEWED = f"""with {_WITH}, taken as (select * from ({_refused_sql(_judge_sql('false'))}) where refused is null),
n as (select case_id, count(*) reviews, count(distinct (upper(outcome), design_id, revision_id)) kinds from taken group by 1),
adjudged as (select x.*, case when x.outcome not in {_LABELS} then 'UNSUPPORTED_OUTCOME' when x.outcome = 'MATCH_DESIGN' and x.design_id is null then 'MATCH_WITHOUT_DESIGN'
  when x.outcome <> 'MATCH_DESIGN' and x.design_id is not null then 'NEGATIVE_WITH_DESIGN' when coalesce(reviews, 0) < 2 then 'TOO_FEW_REVIEWS' when {_FOREIGN} then 'REVISION_OF_OTHER_DESIGN' end refused
  from adjudications x left join n using (case_id) left join revisions v using (revision_id)),
reviewed as (select c.*, coalesce(reviews, 0) reviews, case when coalesce(reviews, 0) < 2 then 'PENDING_SECOND_REVIEW' when kinds = 1 then 'AGREED' else 'ADJUDICATION_REQUIRED' end agreement,
  case when a.case_id is null then 'OPEN' when a.outcome = 'UNRESOLVED' then 'EXCLUDED' else 'ADJUDICATED' end state, a.outcome, a.design_id, a.revision_id
  from cases c left join n using (case_id) left join (select * from adjudged where refused is null) a using (case_id)),
issues as (select dataset_id, 'PROJECT_IN_SEVERAL_SPLITS' issue, project_id "key" from reviewed group by 1, 3 having count(distinct split) > 1
  union all select dataset_id, 'CASE_UNRESOLVED', case_id from reviewed where state = 'OPEN'),
usages as (select 'USE-' || substr(sha256('{{"case":' || case_id || ',"design":"' || design_id || '","input":"' || input_hash || '"}}'), 1, 12) usage_id, project_id, occurrence, design_id, station_id,
  case when case_id % 13 > 0 then role end role, case when case_id % 11 = 0 then 'STALE_SOURCE' else 'CONFIRMED' end status, kind, case when station_id % 3 > 0 then station_id end assembly_id
  from reviewed join datasets using (dataset_id) where outcome = 'MATCH_DESIGN' and input_hash is not null)"""


@query("k10_judge_assertions", f"with {_WITH} select assertion_id, case_id, refused from ({_refused_sql(_judge_sql('''d.status is null or d.status not in ('DRAFT', 'IN_REVIEW')'''))})")
def _(s, d):
    return Labels(s, d).judged().select("assertion_id", "case_id", "refused")


@query("k10_judge_adjudications", f"{_REVIEWED} select adjudication_id, refused from adjudged")
def _(s, d):
    labels = Labels(s, d)
    return labels.decided(labels.taken()).select("adjudication_id", "refused")


@query("k10_review_cases", f"{_REVIEWED} select case_id, reviews, agreement, state, outcome, design_id, revision_id from reviewed")
def _(s, d):
    return Labels(s, d).reviewed().select("case_id", "reviews", "agreement", "state", "outcome", "design_id", "revision_id")


@query("k10_dataset_issues", f"{_REVIEWED} select * from issues")
def _(s, d):
    return lc.dataset_issues(Labels(s, d).reviewed())


@query("k10_lock_datasets", f"""{_REVIEWED},
c as (select dataset_id, count(*) cases, count(distinct project_id) projects, count(distinct design_id) designs from reviewed group by 1), i as (select dataset_id, count(*) issues from issues group by 1),
o as (select dataset_id, status, coalesce(cases, 0) cases, coalesce(projects, 0) projects, coalesce(designs, 0) designs, coalesce(issues, 0) issues from datasets left join c using (dataset_id) left join i using (dataset_id)),
f as (select *, case when issues > 0 then 'INVALID' when status not in ('DRAFT', 'IN_REVIEW') then 'ALREADY_IMMUTABLE' end refused from o)
select dataset_id, case when refused is null then 'LOCKED' else status end status, cases, projects, designs, issues, refused from f""")
def _(s, d):
    labels = Labels(s, d)
    reviewed = labels.reviewed("dataset_id", "project_id", "split", "outcome", "design_id", "state")
    return lc.lock_datasets(labels.datasets, reviewed).select("dataset_id", "status", "cases", "projects", "designs", "issues", "refused")


@query("k11_judge_promotions", f"""{_REVIEWED},
p as (select case_id, case when status not in ('LOCKED', 'APPROVED_FOR_CALIBRATION', 'APPROVED_FOR_VALIDATION') then 'DATASET_NOT_IMMUTABLE' when outcome is null or outcome <> 'MATCH_DESIGN' then 'NOT_A_MATCH'
  when input_hash is null then 'NO_INPUT_HASH' when case_id % 17 = 0 then 'ALREADY_PROMOTED' end refused,
  'USE-' || substr(sha256('{{"case":' || case_id || ',"design":"' || design_id || '","input":"' || input_hash || '"}}'), 1, 12) id from reviewed join datasets using (dataset_id))
select case_id, refused, case when refused is null then id end usage_id from p""")
def _(s, d):
    labels = Labels(s, d)
    cases = labels.reviewed()
    held = cases.where("case_id % 17 = 0").select(lc.usage_id(F.col("case_id"), F.col("design_id"), F.col("input_hash")).alias("usage_id"))
    return lc.judge_promotions(cases, labels.datasets, labels.revisions, held.where("usage_id is not null")).select("case_id", "refused", "usage_id")


@query("g11_search_history", f"""{_REVIEWED}, f as (select * from usages where kind <> 'SYNTHETIC' and role = 'N'),
e as (select * from f where design_id in (select design_id from f group by 1 having count(distinct project_id) >= 2))
select usage_id, project_id, occurrence, design_id, station_id, role, case when status = 'CONFIRMED' then 'CONFIRMED HISTORICAL FACT' else 'STALE CONFIRMATION' end classification, (select count(*) from e) total
from e order by design_id, project_id, occurrence, usage_id limit 100 offset 50""")
def _(s, d):
    return lc.search_history(usages(s, d), role="N", stale=True, least_projects=2, limit=100, offset=50)


@query("g11_unresolved_cases", f"""{_REVIEWED} select case_id, project_id, occurrence, agreement, (select count(*) from reviewed where state = 'OPEN') total from reviewed where state = 'OPEN' order by case_id limit 100""")
def _(s, d):
    return lc.unresolved_cases(Labels(s, d).reviewed())


@query("g4_relationship_snapshot", f"""{_REVIEWED} select design_id, coalesce(role, 'UNKNOWN') role, count(*) occurrences, count(distinct project_id) projects, count(distinct assembly_id) assemblies,
  count(distinct project_id)::double support, cast(sum(('0x' || substr(sha256(usage_id), 1, 15))::hugeint) as varchar) usages_digest,
  string_agg(usage_id, ',' order by usage_id) usage_ids from usages where status = 'CONFIRMED' and kind <> 'SYNTHETIC' group by 1, 2""")
def _(s, d):
    return lc.relationship_snapshot(usages(s, d)).withColumn("usage_ids", F.array_join("usage_ids", ","))
