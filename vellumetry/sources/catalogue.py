"""The catalogue of forms: their fields in reading order, as plain values and as a relation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Form:
    """prefix: of references.  photo: the print's size in millimetres and how much smaller or larger it may be."""

    name: str
    prefix: str
    photo: tuple[float, float, float, float]
    title: str
    summary: tuple[str, ...]
    sections: str


# The two printed forms.  A section's title stands alone on its line; a field's line has its key, label, kind
# and printed options.
FORMS = {
    "school": Form("School Admission Form", "SCH", (35, 45, 0.7, 1.4), "studentName", ("classApplyingFor", "fatherMobile"), """
Student Information
applicationNo | Application No. | text
admissionNo | Admission No. | text
academicYear | Academic Year | text
classApplyingFor | Class Applying For | text
studentName | Student Full Name | name
dateOfBirth | Date of Birth | date
gender | Gender | choice | Male, Female, Other
bloodGroup | Blood Group | text
aadhaarNo | Aadhaar No. | number
nationality | Nationality | text
religion | Religion | text
category | Category | choice | General, OBC, SC, ST, EWS
motherTongue | Mother Tongue | text
address | Address | multiline
city | City | text
state | State | text
pinCode | PIN Code | number
Parent / Guardian Details
fatherName | Father's Name | name
fatherOccupation | Father's Occupation | text
fatherMobile | Father's Mobile No. | phone
fatherEmail | Father's Email | email
motherName | Mother's Name | name
motherOccupation | Mother's Occupation | text
motherMobile | Mother's Mobile No. | phone
motherEmail | Mother's Email | email
guardianName | Guardian's Name | name
guardianRelationship | Relationship | text
guardianContact | Guardian Contact No. | phone
Academic Details
previousSchool | Previous School Name | text
lastClassAttended | Last Class Attended | text
board | Board | text
mediumOfInstruction | Medium of Instruction | text
percentageOrGrade | Percentage / Grade | text
transferCertificateSubmitted | Transfer Certificate Submitted | yesno
Medical / Emergency Details
allergies | Allergies | text
existingMedicalConditions | Existing Medical Conditions | text
doctorName | Doctor Name | name
emergencyContactPerson | Emergency Contact Person | name
emergencyContactNumber | Emergency Contact Number | phone
medicalBloodGroup | Blood Group | text
Required Documents
documents | Documents attached | checklist | Birth Certificate, Aadhaar Copy, Previous Report Card, Transfer Certificate, Address Proof, Passport Size Photographs
"""),
    "hospital": Form("Hospital Patient Form", "HSP", (35, 45, 0.7, 1.5), "patientName", ("phone", "doctorName"), """
Patient Information
patientName | Name | name
email | Email | email
phone | Phone | phone
dateOfBirth | Date of Birth | date
gender | Gender | text
bloodGroup | Blood Group | text
address | Address | multiline
Medical History
allergies | Allergies | yesno
currentMedications | Current Medications | multiline
pastSurgeries | Past Surgeries | multiline
chronicConditions | Chronic Conditions | multiline
Doctor Details
doctorName | Doctor Name | name
insuranceCompany | Insurance Company | text
policyNumber | Policy Number | text
groupNumber | Group Number | text
Consent
consentDate | Date | date
"""),
}


def fields_of(form_id: str) -> list[tuple[int, str, int, str, str, str, list[str]]]:
    """(section_ord, section, field_ord, field, label, kind, options) of a form, in reading order; none for an unknown form."""
    out, section, at = [], "", 0
    for line in FORMS[form_id].sections.strip().split("\n") if form_id in FORMS else []:
        parts = line.split(" | ")
        if len(parts) == 1:
            section, at = line, at + 1
        else:
            out.append((at, section, len(out) + 1, *parts[:3], parts[3].split(", ") if len(parts) > 3 else []))
    return out


def keys_of(form_id: str) -> list[str]:
    return [f[3] for f in fields_of(form_id)]


def empty_values(form_id: str) -> dict[str, str]:
    """What a form starts from: every key blank."""
    return dict.fromkeys(keys_of(form_id), "")


def catalogue(spark: SparkSession) -> DataFrame:
    """form_id, form, and the columns of fields_of: a row a field."""
    rows = [(i, f.name, *r) for i, f in FORMS.items() for r in fields_of(i)]
    return spark.createDataFrame(rows, "form_id string, form string, section_ord int, section string, field_ord int, field string, label string, kind string, options array<string>")
