"""Mapping specs of the supported providers. Each is data for ``landing.normalize_payload``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.functions.parse import euro_range, geo_eligible, parse_timestamp, salary_range
from vakanz.functions.text import blank_to_null, fold
from vakanz.sources.landing import (
    Rule,
    Spec,
    any_contains,
    as_list,
    const,
    first,
    flag,
    flag_labels,
    get,
    html_or_text,
    joined,
    last_segment,
    meta,
    named_value,
    no_list,
    param,
    register,
    same_host,
    sections,
    strings,
    template,
    text,
    time,
    union,
    when_present,
    workplace,
)

REMOTE_WORDS = ("remote", "home office", "homeoffice")
ONSITE_WORDS = ("onsite", "on-site", "office")


def _range(low: str, high: str, currency: str, unit: str, dash: str) -> Rule:
    return lambda i: salary_range(
        text(low)(i), text(high)(i), text(currency)(i), text(unit)(i), dash
    )


def _place(*paths: str) -> Rule:
    return as_list(joined(", ", *[text(p) for p in paths]))


def _url_encoded(rule: Rule) -> Rule:
    return lambda i: F.replace(F.url_encode(rule(i)), F.lit("+"), F.lit("%20"))


register(Spec(
    "greenhouse", ("$.jobs",),
    {
        "source_job_id": text("id"),
        "title": text("title"),
        "company": first(param("company"), text("company_name")),
        "locations": union(as_list(text("location.name")), lambda i: F.filter(
            F.transform(
                F.coalesce(get(i, "offices", "array<variant>"), F.array().cast("array<variant>")),
                lambda o: F.coalesce(
                    blank_to_null(F.try_variant_get(o, "$.location", "string")),
                    blank_to_null(F.try_variant_get(o, "$.name", "string")),
                ),
            ),
            lambda v: v.isNotNull(),
        )),
        "description": text("content"),
        "description_format": const("html"),
        "canonical_url": text("absolute_url"),
        "apply_url": text("absolute_url"),
        "updated_at": time("updated_at"),
        "employment_types": named_value("metadata", ("employment", "commitment")),
        "remote": any_contains(union(strings("location.name"), strings("offices")), ("remote",)),
        "metadata": meta(internal_job_id=text("internal_job_id"), requisition_id=text("requisition_id")),
    },
))

_lever_text = text("descriptionPlain")
register(Spec(
    "lever", ("$", "$.data"),
    {
        "source_job_id": text("id"),
        "title": text("text"),
        "company": param("company"),
        "locations": strings("categories.allLocations", "categories.location"),
        "description": first(_lever_text, text("description")),
        "description_format": first(when_present(_lever_text, "text"), const("html")),
        "canonical_url": text("hostedUrl"),
        "apply_url": text("applyUrl", "hostedUrl"),
        "published_at": time("createdAt"),
        "employment_types": strings("categories.commitment"),
        "remote": workplace(text("workplaceType"), ("remote",), ("on-site", "onsite")),
        "salary": first(_range("salaryRange.min", "salaryRange.max", "salaryRange.currency",
                               "salaryRange.interval", "–"), text("salaryRange")),
        "metadata": meta(team=text("categories.team"), department=text("categories.department"),
                         level=text("categories.level"), workplace_type=text("workplaceType")),
    },
))

_ashby_text = text("descriptionPlain")
register(Spec(
    "ashby", ("$.jobs",),
    {
        "source_job_id": first(text("id"), last_segment(text("jobUrl"))),
        "title": text("title"),
        "company": param("company"),
        "locations": union(strings("location"), strings("secondaryLocations")),
        "description": first(_ashby_text, text("descriptionHtml")),
        "description_format": first(when_present(_ashby_text, "text"), const("html")),
        "canonical_url": text("jobUrl"),
        "apply_url": text("applyUrl", "jobUrl"),
        "published_at": time("publishedAt"),
        "employment_types": strings("employmentType"),
        "remote": flag("isRemote"),
        "salary": text("compensation.scrapeableCompensationSalarySummary",
                       "compensation.compensationTierSummary"),
        "metadata": meta(department=text("department"), team=text("team")),
    },
))


def _smart_mode(i: Column) -> Column:
    remote = flag("location.remote")(i)
    return (
        F.when(get(i, "location.hybrid") == "true", "hybrid").when(remote, "remote").when(~remote, "onsite")
    )


_smart_id = text("id", "uuid")
_smart_url = first(text("postingUrl"), template(
    "https://jobs.smartrecruiters.com/{tenant}/{id}", tenant=param("tenant"), id=_smart_id))
_smart_sections = sections("jobAd.sections")
register(Spec(
    "smartrecruiters", ("$.content",),
    {
        "source_job_id": _smart_id,
        "title": text("name"),
        "company": first(param("company"), text("company.name")),
        "locations": as_list(first(text("location.fullLocation"), joined(
            ", ", text("location.city"), text("location.region"), text("location.country")))),
        "description": _smart_sections,
        "description_format": when_present(_smart_sections, "html"),
        "canonical_url": _smart_url,
        "apply_url": first(text("applyUrl"), _smart_url),
        "published_at": time("releasedDate"),
        "employment_types": as_list(text("typeOfEmployment.label")),
        "remote": flag("location.remote"),
        "metadata": meta(country=text("location.country"), remote_type=_smart_mode,
                         department=text("department.label"), function=text("function.label"),
                         language=text("language.code"), reference=text("refNumber")),
    },
))


def _xml_first(name: str) -> Rule:
    return lambda i: F.try_element_at(
        F.transform(get(i, f"$['{name}']", "array<variant>"), lambda v: v.cast("string")), F.lit(1)
    )


def _xml_all(*names: str) -> Rule:
    def rule(i: Column) -> Column:
        lists = [
            F.coalesce(
                F.transform(get(i, f"$['{n}']", "array<variant>"), lambda v: v.cast("string")),
                no_list(),
            )
            for n in names
        ]
        return F.array_distinct(F.concat(*lists))

    return rule


def _headed(names: str, values: str) -> Rule:
    """Headings and texts of repeated blocks, paired by position."""

    def rule(i: Column) -> Column:
        blocks = F.zip_with(
            F.transform(get(i, f"$['{names}']", "array<variant>"), lambda v: v.cast("string")),
            F.transform(get(i, f"$['{values}']", "array<variant>"), lambda v: v.cast("string")),
            lambda h, t: F.concat(
                F.coalesce(F.concat(F.lit("<h2>"), h, F.lit("</h2>")), F.lit("")), t
            ),
        )
        return F.nullif(F.array_join(F.filter(blocks, lambda b: b.isNotNull()), "\n"), F.lit(""))

    return rule


_personio_places = _xml_all("office", "additionalOffices/office")
_personio_text = _headed("jobDescription/name", "jobDescription/value")
_personio_url = template("{base}/job/{id}?language={language}", base=param("base_url"),
                         id=_xml_first("id"), language=param("language"))
register(Spec(
    "personio",
    ("id", "name", "office", "additionalOffices/office", "subcompany", "jobDescription/name",
     "jobDescription/value", "employmentType", "schedule", "createdAt", "department",
     "recruitingCategory", "seniority", "yearsOfExperience", "occupation"),
    {
        "source_job_id": _xml_first("id"),
        "title": _xml_first("name"),
        "company": first(param("company"), _xml_first("subcompany")),
        "locations": _personio_places,
        "description": _personio_text,
        "description_format": when_present(_personio_text, "html"),
        "canonical_url": _personio_url,
        "apply_url": _personio_url,
        "published_at": lambda i: parse_timestamp(_xml_first("createdAt")(i)),
        "employment_types": _xml_all("employmentType", "schedule"),
        "remote": any_contains(_personio_places, ("remote", "homeoffice", "home office")),
        "metadata": meta(department=_xml_first("department"),
                         recruiting_category=_xml_first("recruitingCategory"),
                         seniority=_xml_first("seniority"),
                         years_of_experience=_xml_first("yearsOfExperience"),
                         occupation=_xml_first("occupation"), language=param("language")),
    },
    payload="xml", xml_items="position",
))


def _https(rule: Rule) -> Rule:
    return lambda i: F.when(rule(i).rlike(r"^https://[^/@?#]+(?:[/?#]|$)"), rule(i))


_feed_text = first(_xml_first("encoded"), _xml_first("description"))
_feed_places = _xml_all("location", "jobLocation")
register(Spec(
    "teamtailor",
    ("title", "link", "guid", "encoded", "description", "location", "jobLocation", "category",
     "employmentType", "jobType", "pubDate", "author"),
    {
        "source_job_id": first(_xml_first("guid"), last_segment(_https(_xml_first("link")))),
        "title": _xml_first("title"),
        "company": param("company"),
        "locations": _feed_places,
        "description": _feed_text,
        "description_format": when_present(_feed_text, "html"),
        "canonical_url": _https(_xml_first("link")),
        "apply_url": _https(_xml_first("link")),
        "published_at": lambda i: parse_timestamp(_xml_first("pubDate")(i)),
        "employment_types": _xml_all("employmentType", "jobType"),
        "remote": any_contains(_xml_all("location", "jobLocation", "category"), ("remote",)),
        "metadata": meta(author=_xml_first("author")),
    },
    payload="xml", xml_items="item",
))

_join_url = template("https://join.com/companies/{tenant}/{id}", tenant=param("tenant"),
                     id=_url_encoded(text("idParam", "id")))
register(Spec(
    "join", ("$.props.pageProps.initialState.jobs.items",),
    {
        "source_job_id": text("id"),
        "title": text("title"),
        "company": param("company"),
        "locations": _place("city.cityName", "city.countryName"),
        "canonical_url": _join_url,
        "apply_url": _join_url,
        "published_at": time("createdAt"),
        "updated_at": time("updatedAt"),
        "employment_types": as_list(text("employmentType.name")),
        "remote": workplace(text("workplaceType"), ("remote",)),
        "metadata": meta(workplace_type=text("workplaceType")),
    },
))


def _absolute(rule: Rule) -> Rule:
    from vakanz.functions.urls import resolve

    return lambda i: resolve(
        F.concat(F.regexp_replace(param("base_url")(i), "/+$", ""), F.lit("/")), rule(i)
    )


_sf_text = text("jobDescription", "description")
_sf_url = _absolute(text("url", "jobUrl", "canonicalUrl"))
register(Spec(
    "successfactors",
    ("$.searchResults.jobs", "$.data.jobs", "$.results.jobs", "$.searchResults.results",
     "$.data.results", "$.data.jobPostings", "$.jobs", "$.results", "$.jobPostings",
     "$.searchResults"),
    {
        "source_job_id": text("jobId", "jobReqId", "requisitionId", "id"),
        "title": text("jobTitle", "title", "name"),
        "company": first(param("company"), text("company", "companyName")),
        "locations": strings("locations", "location", "jobLocation"),
        "description": _sf_text,
        "description_format": when_present(_sf_text, "html"),
        "canonical_url": _sf_url,
        "apply_url": first(text("applyUrl"), _sf_url),
        "published_at": time("postedDate", "datePosted"),
        "updated_at": time("updatedDate", "lastModified"),
        "employment_types": strings("employmentType", "jobType"),
        "metadata": meta(requisition_id=text("requisitionId", "jobReqId")),
    },
))


def _last_bullet(i: Column) -> Column:
    return F.try_element_at(strings("bulletFields")(i), F.lit(-1))


_wd_url = template("{base}/{site}/{path}", base=param("base_url"), site=param("tenant"),
                   path=lambda i: F.regexp_replace(text("externalPath")(i), "^/+", ""))
register(Spec(
    "workday", ("$.jobPostings",),
    {
        "source_job_id": first(text("id"), last_segment(text("externalPath")), _last_bullet),
        "title": text("title"),
        "company": param("company"),
        "locations": strings("locations", "location", "displayLocation"),
        "description": text("description"),
        "description_format": when_present(text("description"), "html"),
        "canonical_url": _wd_url,
        "apply_url": _wd_url,
        "published_at": time("postedOn", "postedDate"),
        "employment_types": strings("timeType", "employmentType"),
        "metadata": meta(external_path=text("externalPath")),
    },
))

_workable_id = text("shortcode", "id")
_workable_text = text("description", "description_html")
_workable_url = first(text("url", "shortlink"), template(
    "https://apply.workable.com/{tenant}/j/{id}/", tenant=param("tenant"), id=_url_encoded(_workable_id)))
register(Spec(
    "workable", ("$.jobs", "$.account.jobs"),
    {
        "source_job_id": _workable_id,
        "title": text("title"),
        "company": param("company"),
        "locations": as_list(first(
            text("location.location_str", "location.name"),
            joined(", ", text("location.city"), text("location.region"), text("location.country")),
            text("location"))),
        "description": _workable_text,
        "description_format": when_present(_workable_text, "html"),
        "canonical_url": _workable_url,
        "apply_url": first(text("application_url"), _workable_url),
        "published_at": time("published_on", "created_at"),
        "updated_at": time("updated_at"),
        "employment_types": strings("employment_type", "type"),
        "remote": first(flag("remote"), workplace(text("location.workplace_type"), ("remote",),
                                                  ("on-site", "onsite"))),
        "metadata": meta(department=text("department.name", "department")),
    },
))

_recruitee_places = union(strings("location"), strings("locations"))
_recruitee_text = text("description", "description_html", "descriptionHtml")
_recruitee_url = first(
    same_host(text("careers_url", "careersUrl"), param("base_url")),
    template("{base}/o/{slug}", base=param("base_url"), slug=_url_encoded(text("slug"))))
register(Spec(
    "recruitee", ("$.offers",),
    {
        "source_job_id": text("id", "slug"),
        "title": text("title"),
        "company": first(param("company"), text("company_name")),
        "locations": _recruitee_places,
        "description": _recruitee_text,
        "description_format": when_present(_recruitee_text, "html"),
        "canonical_url": _recruitee_url,
        "apply_url": first(same_host(text("apply_url", "applyUrl"), param("base_url")), _recruitee_url),
        "published_at": time("published_at", "publishedAt"),
        "updated_at": time("updated_at", "updatedAt"),
        "employment_types": strings("employment_type", "employmentType"),
        "remote": first(flag("remote"), any_contains(_recruitee_places, ("remote",))),
        "salary": text("salary"),
        "metadata": meta(department=text("department"), category=text("category"),
                         experience_code=text("experience_code")),
    },
))

_oracle_text = text("ExternalDescriptionStr", "externalDescriptionStr", "JobDescription",
                    "jobDescription", "ShortDescriptionStr", "shortDescriptionStr")
_oracle_mode = text("WorkplaceType", "workplaceType", "RemoteType", "remoteType")
_oracle_url = same_host(text("JobDetailUrl", "jobDetailUrl", "ExternalUrl", "externalUrl",
                             "JobUrl", "jobUrl"), param("base_url"))
register(Spec(
    "oracle", ("$.items[0].requisitionList", "$.items"),
    {
        "source_job_id": text("Id", "id", "RequisitionId", "requisitionId", "RequisitionNumber",
                              "requisitionNumber", "JobId", "jobId"),
        "title": text("Title", "title", "JobTitle", "jobTitle"),
        "company": first(param("company"), text("LegalEmployerName", "CompanyName", "company")),
        "locations": union(
            as_list(text("PrimaryLocation", "primaryLocation", "Location", "location")),
            strings("OtherWorkLocations", "otherWorkLocations")),
        "description": _oracle_text,
        "description_format": html_or_text(_oracle_text),
        "canonical_url": _oracle_url,
        "apply_url": first(same_host(text("ApplyUrl", "applyUrl", "CandidateApplyUrl",
                                          "candidateApplyUrl"), param("base_url")), _oracle_url),
        "published_at": time("PostedDate", "postedDate", "PublicationDate"),
        "updated_at": time("LastUpdateDate", "lastUpdateDate"),
        "employment_types": strings("WorkerType", "workerType", "JobType", "jobType"),
        "remote": workplace(_oracle_mode, REMOTE_WORDS, ONSITE_WORDS, part=True),
        "metadata": meta(requisition_number=text("RequisitionNumber", "requisitionNumber"),
                         job_code=text("JobCode", "jobCode"),
                         department=text("DepartmentName", "departmentName"),
                         workplace_type=_oracle_mode),
    },
))

_phenom_text = text("description", "jobDescription", "descriptionHtml", "jobDescriptionText")
_phenom_mode = text("workplaceType", "workLocationType", "remoteType")
_phenom_url = same_host(text("jobUrl", "url", "jobDetailUrl", "externalPath", "seoUrl"), param("base_url"))
_phenom_listed = strings("locations", "location", "jobLocation")
_phenom_place = as_list(joined(", ", text("city"), text("state", "region"), text("country")))
_phenom_roots = ("$.refineSearch", "$.data.refineSearch", "$.data", "$")
register(Spec(
    "phenom",
    tuple(f"{root}.{key}" for root in _phenom_roots
          for key in ("jobs", "jobs.hits", "jobResults", "results", "hits", "hits.hits")),
    {
        "source_job_id": text("jobId", "jobID", "id", "reqId", "requisitionId", "requisitionNumber"),
        "title": text("title", "jobTitle", "name"),
        "company": first(param("company"), text("company", "companyName", "brand")),
        "locations": lambda i: F.when(F.size(_phenom_listed(i)) > 0, _phenom_listed(i)).otherwise(_phenom_place(i)),
        "description": _phenom_text,
        "description_format": html_or_text(_phenom_text),
        "canonical_url": _phenom_url,
        "apply_url": first(same_host(text("applyUrl", "applyURL", "applicationUrl"), param("base_url")),
                           _phenom_url),
        "published_at": time("postedDate", "datePosted", "publicationDate", "createdDate"),
        "updated_at": time("updatedDate", "lastModifiedDate"),
        "employment_types": strings("employmentType", "jobType", "schedule"),
        "remote": first(flag("remote"), workplace(_phenom_mode, REMOTE_WORDS, ONSITE_WORDS, part=True)),
        "metadata": meta(requisition_number=text("requisitionNumber", "reqId"),
                         category=text("category", "jobCategory"),
                         department=text("department", "function"), workplace_type=_phenom_mode),
    },
    unwrap="$._source",
))

for _name, _ids, _titles, _urls, _places, _posted, _updated in (
    ("radancy", ("id", "jobId", "requisitionId", "reqId"), ("title", "name", "jobTitle"),
     ("url", "jobUrl", "href"), ("locations", "location", "city"), ("datePosted", "postedDate"),
     ("updatedDate",)),
    ("beesite", ("id", "jobId", "referenceNumber", "requisitionId"), ("title", "jobTitle", "name"),
     ("url", "detailUrl", "jobUrl"), ("locations", "location"), ("publishedAt", "datePosted"),
     ("updatedAt",)),
):
    _link = same_host(text(*_urls), param("base_url"))
    _ident = text(*_ids)
    _said = text("description", "summary")
    register(Spec(
        _name, ("$.jobs", "$.results", "$.items", "$.data", "$"),
        {
            "source_job_id": first(_ident, last_segment(text(*_urls))) if _name == "radancy" else _ident,
            "title": text(*_titles),
            "company": first(param("company"), text("company", "brand")),
            "locations": strings(*_places),
            "description": _said,
            "description_format": html_or_text(_said),
            "canonical_url": _link,
            "apply_url": first(same_host(text("applyUrl"), param("base_url")), _link),
            "published_at": time(*_posted),
            "updated_at": time(*_updated),
            "employment_types": strings("employmentType", "jobType"),
        },
    ))

register(Spec(
    "arbeitnow", ("$.data",),
    {
        "source_job_id": text("slug"),
        "title": text("title"),
        "company": text("company_name"),
        "locations": as_list(text("location")),
        "description": text("description"),
        "description_format": const("html"),
        "canonical_url": text("url"),
        "apply_url": text("url"),
        "published_at": time("created_at"),
        "employment_types": strings("job_types"),
        "remote": flag("remote"),
        "metadata": meta(country=const("DE"), remote_type=lambda i: F.when(flag("remote")(i), "remote")),
    },
))


def _adzuna_types(i: Column) -> Column:
    hours = text("contract_time")(i)
    known = F.when(fold(hours).isin("full_time", "part_time"), hours)
    return F.filter(F.array(text("contract_type")(i), known), lambda v: v.isNotNull())


_adzuna_pay: Rule = lambda i: euro_range(text("salary_min")(i), text("salary_max")(i))
register(Spec(
    "adzuna", ("$.results",),
    {
        "source_job_id": text("id"),
        "title": text("title"),
        "company": text("company.display_name"),
        "locations": as_list(text("location.display_name")),
        "description": text("description"),
        "description_format": when_present(text("description"), "html"),
        "apply_url": text("redirect_url"),
        "published_at": time("created"),
        "employment_types": _adzuna_types,
        "salary": _adzuna_pay,
        "metadata": meta(adzuna_category=text("category.label"), salary=_adzuna_pay),
    },
))

register(Spec(
    "jooble", ("$.jobs",),
    {
        "source_job_id": lambda i: F.substring(F.sha2(text("link")(i), 256), 1, 24),
        "title": text("title"),
        "locations": as_list(text("location")),
        "description": text("snippet"),
        "description_format": const("text"),
        "canonical_url": text("link"),
        "apply_url": text("link"),
        "published_at": time("updated"),
        "salary": text("salary"),
        "employment_types": strings("type"),
        "metadata": meta(jooble_source=text("source")),
    },
))


def _jobicy_pay(i: Column) -> Column:
    low, high = text("annualSalaryMin", "salaryMin")(i), text("annualSalaryMax", "salaryMax")(i)
    amount = F.when(high.isNull() | (low == high), low).otherwise(
        F.concat(F.coalesce(low, F.lit("0")), F.lit("–"), high)
    )
    shown = F.concat_ws(" ", amount, text("salaryCurrency")(i), text("salaryPeriod")(i))
    return F.when(amount.isNotNull(), shown)


register(Spec(
    "jobicy", ("$.jobs",),
    {
        "source_job_id": text("id"),
        "title": text("jobTitle"),
        "company": text("companyName"),
        "locations": as_list(first(text("jobGeo"), const("Remote"))),
        "description": text("jobDescription"),
        "description_format": const("html"),
        "canonical_url": text("url"),
        "apply_url": text("url"),
        "published_at": time("pubDate"),
        "employment_types": strings("jobType"),
        "remote": const(True),
        "salary": _jobicy_pay,
        "metadata": meta(country=const("DE"), remote_type=const("remote"),
                         industry=lambda i: F.nullif(F.array_join(strings("jobIndustry")(i), ", "), F.lit("")),
                         level=text("jobLevel")),
    },
    keep=lambda i: geo_eligible(text("jobGeo")(i)),
))

register(Spec(
    "remotive", ("$.jobs",),
    {
        "source_job_id": text("id"),
        "title": text("title"),
        "company": text("company_name"),
        "locations": as_list(first(text("candidate_required_location"), const("Remote"))),
        "description": text("description"),
        "description_format": const("html"),
        "canonical_url": text("url"),
        "apply_url": text("url"),
        "published_at": time("publication_date"),
        "employment_types": strings("job_type"),
        "remote": const(True),
        "salary": text("salary"),
        "metadata": meta(country=const("DE"), remote_type=const("remote"), category=text("category")),
    },
    keep=lambda i: geo_eligible(text("candidate_required_location")(i)),
))


# Public employment service: an item is {"summary": {...}, "detail": {...}}, joined beforehand
# by the reference number; detail wins field by field.
def _both(*names: str) -> tuple[str, ...]:
    return tuple(f"detail.{n}" for n in names) + tuple(f"summary.{n}" for n in names)


def _ba_address(a: Column) -> Column:
    def part(*names: str) -> Column:
        return F.coalesce(
            *[
                blank_to_null(F.try_variant_get(a, f"$.{p}{n}", "string"))
                for n in names
                for p in ("adresse.", "")
            ]
        )

    city, region, country = part("ort", "name"), part("region"), part("land")
    local = F.nullif(F.concat_ws(" ", part("plz"), city), F.lit(""))
    region = F.when(~fold(region).eqNullSafe(fold(city)), region)
    abroad = F.when(~fold(country).isin("deutschland", "germany"), country)
    return F.nullif(F.concat_ws(", ", local, region, abroad), F.lit(""))


def _ba_locations(i: Column) -> Column:
    values = F.coalesce(
        *[
            get(i, p, "array<variant>")
            for p in ("detail.stellenlokationen", "detail.arbeitsorte", "summary.stellenlokationen",
                      "summary.arbeitsorte")
        ],
        F.filter(F.array(get(i, "summary.arbeitsort", "variant")), lambda v: v.isNotNull()),
    )
    return F.array_distinct(
        F.filter(F.transform(values, _ba_address), lambda v: v.isNotNull())
    )


def _ba_types(i: Column) -> Column:
    listed = strings("detail.arbeitszeitmodelle", "summary.arbeitszeitmodelle")(i)
    flags = flag_labels(fixed.WORKING_TIME_FLAGS, "detail", "summary")(i)
    return F.when(F.size(listed) > 0, listed).otherwise(flags)


def _ba_remote(i: Column) -> Column:
    kinds = fold(F.array_join(_ba_types(i), " "))
    home = F.lower(text(*_both("homeofficemoeglich"))(i))
    other = F.lower(text(*_both("remote"))(i))

    def known(c: Column) -> Column:
        return F.when(c.isin("true", "false"), c == "true")

    return F.when(kinds.rlike("heim|tele|remote"), True).otherwise(
        F.coalesce(known(home), known(other))
    )


def _ba_answer(*names: str) -> Rule:
    def rule(i: Column) -> Column:
        value = text(*_both(*names))(i)
        return F.when(~fold(value).isin(*fixed.NO_ANSWER), value)

    return rule


def _ba_mode(i: Column) -> Column:
    kind = fold(F.coalesce(text(*_both("homeofficetyp"))(i), F.lit("")))
    full = kind.isin("vollstaendig", "vollständig", "ausschliesslich")
    return F.when(_ba_remote(i), F.when(full, "remote").otherwise("hybrid"))


_ba_ref = text("summary.referenznummer", "summary.refnr", "detail.referenznummer")
_ba_url = template("https://www.arbeitsagentur.de/jobsuche/jobdetail/{ref}", ref=_url_encoded(_ba_ref))
register(Spec(
    "ba_jobsuche", ("$.items",),
    {
        "source_job_id": _ba_ref,
        "title": text("detail.stellenangebotsTitel", "detail.titel", "summary.stellenangebotsTitel",
                      "summary.titel", "summary.beruf"),
        "company": text(*_both("firma", "arbeitgeber")),
        "locations": _ba_locations,
        "description": text("detail.stellenangebotsBeschreibung", "detail.stellenbeschreibung"),
        "description_format": const("text"),
        "canonical_url": _ba_url,
        "apply_url": first(text("detail.externeUrl", "detail.externeURL", "detail.bewerbungsUrl",
                                "detail.bewerbungsURL", "summary.externeUrl", "summary.externeURL"),
                           _ba_url),
        "published_at": time("detail.datumErsteVeroeffentlichung",
                             "detail.ersteVeroeffentlichungsdatum",
                             "detail.aktuelleVeroeffentlichungsdatum",
                             "summary.datumErsteVeroeffentlichung",
                             "summary.aktuelleVeroeffentlichungsdatum"),
        "updated_at": time(*_both("aenderungsdatum", "modifikationsTimestamp")),
        "employment_types": _ba_types,
        "remote": _ba_remote,
        "salary": _ba_answer("verguetungsangabe", "verguetung"),
        "metadata": meta(reference_number=_ba_ref,
                         contract_type=_ba_answer("vertragsdauer", "befristung"),
                         occupation=text(*_both("hauptberuf", "beruf")),
                         industry=text(*_both("branche")), remote_type=_ba_mode,
                         homeoffice_type=text(*_both("homeofficetyp"))),
    },
))


def _tkms_remote(i: Column) -> Column:
    return F.when(fold(text("remote")(i)).rlike("hybrid|remote"), True)


_tkms_url = template("https://jobs.tkmsgroup.com/{language}/job/{id}", language=param("language"),
                     id=text("id", "idClient"))
register(Spec(
    "tkms", ("$.jobs",),
    {
        "source_job_id": text("id", "idClient"),
        "title": text("title"),
        "company": text("company"),
        "locations": strings("locations", "cityState", "city"),
        "canonical_url": _tkms_url,
        "apply_url": first(lambda i: F.concat(F.lit("https://jobs.tkmsgroup.com/"), F.regexp_replace(
            text("applicationUrl")(i), "^/+", "")), _tkms_url),
        "published_at": time("postingDate"),
        "employment_types": strings("employmentType"),
        "remote": _tkms_remote,
        "metadata": meta(contract=text("contract"), entry_level=text("entryLevel"),
                         job_field=text("jobField"), job_number=text("jobNumber")),
    },
    unwrap="$.data",
))


# An item joins a search hit with the JSON-LD of its detail page: {id, url, title, job}.
def _ld_places(i: Column) -> Column:
    entries = F.coalesce(
        get(i, "job.jobLocation", "array<variant>"),
        F.filter(F.array(get(i, "job.jobLocation", "variant")), lambda v: v.isNotNull()),
    )

    def render(e: Column) -> Column:
        def part(name: str) -> Column:
            return blank_to_null(F.try_variant_get(e, f"$.address.{name}", "string"))

        country = F.coalesce(
            blank_to_null(F.try_variant_get(e, "$.address.addressCountry.name", "string")),
            part("addressCountry"),
        )
        full = F.concat_ws(", ", part("streetAddress"), part("postalCode"), part("addressLocality"),
                           part("addressRegion"), country)
        plain = F.try_variant_get(e, "$.address", "string")
        return F.coalesce(
            F.nullif(full, F.lit("")),
            F.when(~plain.startswith("{"), blank_to_null(plain)),
            blank_to_null(F.try_variant_get(e, "$.name", "string")),
        )

    found = F.filter(F.transform(entries, render), lambda v: v.isNotNull())
    return F.coalesce(F.array_distinct(found), no_list())


_icims_url = first(same_host(text("job.url"), text("url")), text("url"))
register(Spec(
    "icims", ("$.items",),
    {
        "source_job_id": text("id"),
        "title": text("job.title", "title"),
        "company": first(param("company"), text("job.hiringOrganization.name")),
        "locations": _ld_places,
        "description": text("job.description"),
        "description_format": when_present(text("job.description"), "html"),
        "canonical_url": _icims_url,
        "apply_url": _icims_url,
        "published_at": time("job.datePosted"),
        "updated_at": time("job.dateModified"),
        "employment_types": strings("job.employmentType"),
        "remote": lambda i: F.when(
            F.contains(fold(F.coalesce(text("job.jobLocationType")(i), F.lit(""))), F.lit("telecommute")),
            True,
        ).otherwise(any_contains(_ld_places, ("remote",))(i)),
        "salary": first(_range("job.baseSalary.value.minValue", "job.baseSalary.value.maxValue",
                               "job.baseSalary.currency", "job.baseSalary.value.unitText", "–"),
                        text("job.baseSalary")),
        "metadata": meta(identifier=text("job.identifier.value", "job.identifier"),
                         valid_through=text("job.validThrough"), direct_apply=text("job.directApply")),
    },
))


# Result pages without an API: cards of a landed page.
def _listed(name: str, separator: str) -> Rule:
    def rule(i: Column) -> Column:
        parts = F.transform(
            F.split(text(name)(i), separator), lambda p: F.regexp_replace(p, r"^[ ,]+|[ ,]+$", "")
        )
        return F.coalesce(F.array_distinct(F.filter(parts, lambda p: p != "")), no_list())

    return rule


_db_url = lambda i: F.concat(F.lit("https://db.jobs/"), F.regexp_replace(text("href")(i), "^/+", ""))
register(Spec(
    "deutsche_bahn", (),
    {
        "source_job_id": text("id"),
        "title": text("title"),
        "company": text("company"),
        "locations": _listed("location", ","),
        "canonical_url": _db_url,
        "apply_url": _db_url,
    },
    payload="html",
    cards=r"(?is)<a\b(?=[^>]*\bm-search-hit\b)[^>]*>.*?</a>",
    parts={
        "id": r'data-job-id="([^"]*)"',
        "href": r'\bhref="([^"]*)"',
        "title": r'(?is)m-search-hit__title-text[^>]*>(.*?)</',
        "location": r'(?is)aria-label="Arbeitsort"[^>]*>\s*</i>(.*?)</(?:div|span|li|p)>',
        "company": r'(?is)aria-label="Arbeitgeber(?::in)?"[^>]*>\s*</i>(.*?)</(?:div|span|li|p)>',
    },
))


def _card_part(n: int) -> Rule:
    return lambda i: blank_to_null(
        F.try_element_at(F.split(text("line")(i), r" \| ", 3), F.lit(n))
    )


_rm_url = lambda i: F.concat(F.lit("https://www.rheinmetall.com/"), F.regexp_replace(text("href")(i), "^/+", ""))
register(Spec(
    "rheinmetall", (),
    {
        "source_job_id": lambda i: F.nullif(
            F.regexp_extract(text("href")(i), r"/(\d+)(?:[/?#]|$)", 1), F.lit("")
        ),
        "title": _card_part(1),
        "company": first(_card_part(2), const("Rheinmetall")),
        "locations": as_list(_card_part(3)),
        "canonical_url": _rm_url,
        "apply_url": _rm_url,
    },
    payload="html",
    cards=r'(?is)<a\b[^>]*href="[^"]*/(?:de|en)/job/[^"]*"[^>]*>.*?</a>',
    parts={"href": r'\bhref="([^"]*)"', "line": r"(?is)^<a\b[^>]*>(.*)</a>$"},
))

_sg_url = _absolute(text("href"))
register(Spec(
    "softgarden", (),
    {
        "source_job_id": first(lambda i: F.nullif(
            F.regexp_extract(text("href")(i), r"/job/(\d+)", 1), F.lit("")), text("id")),
        "title": text("title"),
        "company": param("company"),
        "locations": _listed("location", ";"),
        "canonical_url": _sg_url,
        "apply_url": _sg_url,
        "published_at": time("date"),
    },
    payload="html",
    cards=r'(?is)<[a-z]+\b(?=[^>]*\bmatchElement\b)[^>]*\bid="job_id_.*?(?=<[a-z]+\b[^>]*\bmatchElement\b|\z)',
    parts={
        "id": r'\bid="job_id_([^"]*)"',
        "href": r'(?is)<a\b[^>]*href="([^"]*/job/[^"]*)"',
        "title": r'(?is)<a\b[^>]*href="[^"]*/job/[^"]*"[^>]*>(.*?)</a>',
        "date": r'(?is)class="[^"]*\bdate\b[^"]*"[^>]*>(.*?)</',
        "location": r'(?is)class="[^"]*ProjectGeoLocationCity[^"]*"[^>]*>(.*?)</',
    },
))


def _interamt_remote(i: Column) -> Column:
    mode = fold(text("Dienstort")(i))
    return F.when(mode.rlike("hybrid|homeoffice|remote"), True).when(mode.rlike("vor ort|präsenz"), False)


_ia_fields = ("StellenangebotId", "Stellenbezeichnung", "PLZOrte", "Dienstort", "Behoerde", "Von",
              "Bewerbungsfrist", "BesoldungGruppeDisplayString", "TarifEbeneDisplayString")
_ia_id: Rule = lambda i: F.nullif(F.regexp_extract(text("StellenangebotId")(i), r"^(\d+)", 1), F.lit(""))
_ia_url = template("https://interamt.de/koop/app/stelle?id={id}", id=_ia_id)
register(Spec(
    "interamt", (),
    {
        "source_job_id": _ia_id,
        "title": text("Stellenbezeichnung"),
        "company": text("Behoerde"),
        "locations": as_list(text("PLZOrte")),
        "canonical_url": _ia_url,
        "apply_url": _ia_url,
        "published_at": time("Von"),
        "remote": _interamt_remote,
        "salary": joined(" / ", text("BesoldungGruppeDisplayString"), text("TarifEbeneDisplayString")),
        "metadata": meta(workplace_type=text("Dienstort"), application_deadline=text("Bewerbungsfrist"),
                         pay_grade=text("BesoldungGruppeDisplayString"),
                         collective_pay=text("TarifEbeneDisplayString")),
    },
    payload="html",
    cards=r"(?is)<tr\b(?=[^>]*\bia-e-table__row\b)[^>]*>.*?</tr>",
    parts={n: rf'(?is)<td\b[^>]*data-field="{n}"[^>]*>(.*?)</td>' for n in _ia_fields},
    escaped=True,
))
